"""Normal and Student distributions as column expressions, for result tables of any size."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Wichura's rational approximations (Applied Statistics 37, 1988, algorithm AS 241), highest power first.
NEAR = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
OUTER = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)
#: Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_tail(x: Column) -> Column:
    """P(Z > x): a series of positive terms up to 3, beyond it a continued fraction, which keeps small tails exact."""

    def upper(a: Column) -> Column:
        density = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
        zero = F.struct(a.alias("t"), a.alias("s"))
        term = lambda z, n: z["t"] * a * a / (2 * n + 1)
        series = F.aggregate(steps(60), zero, lambda z, n: let(term(z, n), lambda t: F.struct(t.alias("t"), (z["s"] + t).alias("s"))), lambda z: z["s"])
        fraction = F.aggregate(steps(80), a, lambda z, n: a + (F.lit(81.0) - n) / z)
        return F.when(a <= 3, 0.5 - density * series).otherwise(density / fraction)

    return let(F.abs(x.cast("double")), lambda a: let(upper(a), lambda u: F.when(x >= 0, u).otherwise(1 - u)))


def normal_cdf(x: Column) -> Column:
    """P(Z <= x)."""
    return normal_tail(-x)


def normal_quantile(p: Column) -> Column:
    """The z with P(Z <= z) = p; null outside of 0 < p < 1."""
    q = p.cast("double") - 0.5
    ratio = lambda x, pair: _horner(x, pair[0]) / _horner(x, pair[1])
    near = let(F.lit(0.180625) - q * q, lambda r: q * ratio(r, NEAR))
    tail = let(F.sqrt(-F.ln(F.least(p, 1 - p))), lambda r: F.when(r <= 5, let(r - 1.6, lambda s: ratio(s, OUTER))).otherwise(let(r - 5, lambda s: ratio(s, FAR))))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, near).otherwise(F.signum(q) * tail))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series eight above."""
    up = lambda y: F.lit(0.5 * math.log(2 * math.pi)) + (y - 0.5) * F.ln(y) - y + _horner(1 / (y * y), STIRLING[::-1]) / y
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    return let(x + 8, up) - F.ln(shift)


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 400) -> Column:
    """The regularised incomplete beta function of 0 <= x <= 1 by its continued fraction, from the inside out."""

    def lower(x: Column, a: Column, b: Column) -> Column:
        def part(m: Column, odd: bool) -> Column:
            if odd:
                return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

        # Both parts of step m; m runs down to 0, whose even part is the leading 1.
        fraction = F.aggregate(steps(terms // 2), F.lit(1.0), lambda z, n: let(F.lit(terms // 2) - n.cast("double"), lambda m: let(1 + part(m, True) / z, lambda w: F.when(m > 0, 1 + part(m, False) / w).otherwise(w))))
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
        return front / fraction

    inside = F.when(x < (a + 1) / (a + b + 2), lower(x, a, b)).otherwise(1 - lower(1 - x, b, a))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def t_tail(t: Column, dof: Column) -> Column:
    """P(T > t) of Student's distribution."""
    half = lambda u: incomplete_beta(dof / (dof + u * u), dof / 2, F.lit(0.5)) / 2
    return let(t.cast("double"), lambda u: let(half(u), lambda h: F.when(u >= 0, h).otherwise(1 - h)))


def t_quantile(p: float, dof: Column) -> Column:
    """The t with P(T <= t) = p for ``p`` above a half, by Newton's steps from the normal's, which come from below."""
    q = 1 - p

    def solve(nu: Column) -> Column:
        scale = log_gamma((nu + 1) / 2) - log_gamma(nu / 2) - F.ln(nu * math.pi) / 2
        density = lambda t: F.exp(scale - (nu + 1) / 2 * F.log1p(t * t / nu))
        return F.aggregate(steps(24), normal_quantile(F.lit(p)), lambda t, _: t + (t_tail(t, nu) - q) / density(t))

    return let(dof.cast("double"), solve)
