"""Statistical comparison of systems over result tables. Random choices are hashes, so results repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_tail


def hash_int(*parts: Column) -> Column:
    """A 32-bit number from the MD5 of parts joined by colons; the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def macro_average(results: DataFrame, value: str, group: str, keys: list[str] | None = None) -> DataFrame:
    """The mean of the groups' means."""
    means = results.groupBy(*(keys or []), group).agg(F.avg(value).alias("_m"))
    return means.groupBy(*(keys or [])).agg(F.avg("_m").alias("macro"), F.count("*").alias("n_groups"))


def bootstrap_macro(results: DataFrame, value: str, group: str, draws: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the macro average over ``draws`` resamples within groups; rows have an ``id``."""
    from .bootstrap import macro_draws

    macro = macro_draws(results, value, group, "id", [], draws, seed)
    return macro.agg(F.percentile("d", alpha / 2).alias("low"), F.percentile("d", 1 - alpha / 2).alias("high"), F.count("*").alias("draws"))


def permutation_test(paired: DataFrame, a: str, b: str, draws: int, seed: int = 42, keys: list[str] | None = None) -> DataFrame:
    """One-sided paired test of mean(b) > mean(a): signs flip by hash; p = (1 + draws at least as large) / (1 + draws).

    ``p`` is null unless b is better on the whole. Rows have an ``id``; sums that differ by rounding alone are equal.
    """
    from .bootstrap import flip_sums

    keys = keys or []
    d = paired.select(*keys, "id", (F.col(b) - F.col(a)).cast("double").alias("d"))
    observed = d.groupBy(*keys).agg(F.sum("d").alias("obs"), F.sum(F.abs("d")).alias("size"))
    sums = flip_sums(d, "d", keys, "id", draws, seed)
    both = sums.join(observed, keys) if keys else sums.join(F.broadcast(observed), F.lit(True))  # without keys one row
    large = F.count_if(F.col("s") >= F.col("obs") - 1e-12 * F.col("size"))
    return both.groupBy(*keys).agg(F.first("obs").alias("observed"), large.alias("n_as_large"), F.when(F.first("obs") > 0, (1 + large) / (1 + F.count("*"))).alias("p"))


def average_rank(value: str, keys: list[str], weight: str = "_w") -> Column:
    """Rank with ties averaged, over rows that stand for ``weight`` rows each: windows hold distinct values, not all rows."""
    upto = F.sum(weight).over(Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.sum(weight).over(Window.partitionBy(*keys, value))
    return upto - same + (same + 1) / 2


def wilcoxon(paired: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Signed-rank sums of b - a with zeros ranked and then left out (Pratt), the normal approximation's z and its p for b > a."""
    d = paired.groupBy(*keys, (F.col(b) - F.col(a)).alias("d")).agg(F.count("*").alias("_w")).withColumn("_abs", F.abs("d"))
    ranked = d.withColumn("r", average_rank("_abs", keys))
    total = lambda c: F.sum(c * F.col("_w"))
    sums = ranked.groupBy(*keys).agg(total(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), total(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"), F.sum("_w").alias("n"), F.coalesce(F.sum(F.when(F.col("d") == 0, F.col("_w"))), F.lit(0)).alias("n_zero"), total(F.when(F.col("d") != 0, F.col("r") * F.col("r"))).alias("_ss"))
    n, z = F.col("n"), F.col("n_zero")
    mean = (n * (n + 1) - z * (z + 1)) / 4
    return sums.withColumn("z", F.when(F.col("_ss") > 0, (F.col("w_plus") - mean) / F.sqrt(F.col("_ss") / 4))).withColumn("p", normal_tail(F.col("z"))).drop("_ss")


def correlations(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson and Spearman correlation per key, from counts of distinct (x, y) values; rows without either value count for nothing."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").alias("_w"))
    ranked = cells.withColumn("rx", average_rank("x", keys)).withColumn("ry", average_rank("y", keys))
    every = Window.partitionBy(*keys)
    # Around the means, so that sums of squares stay small.
    for c in ("x", "y", "rx", "ry"):
        ranked = ranked.withColumn(c, F.col(c) - F.sum(F.col(c) * F.col("_w")).over(every) / F.sum("_w").over(every))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_w"))
    corr = lambda a, b: F.when((dot(a, a) > 0) & (dot(b, b) > 0), dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))
    return ranked.groupBy(*keys).agg(corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"))


def kendall_tau_b(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Kendall's tau-b per key from counts of distinct (x, y) values, so repeated values cost nothing."""
    cells = df.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    a = cells.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1"))
    both = a.join(cells, keys) if keys else a.join(cells, F.lit(True))
    sign = F.signum(F.col("x1") - F.col("x")) * F.signum(F.col("y1") - F.col("y"))
    pairs = F.col("n1") * F.col("n")
    sums = both.groupBy(*keys).agg((F.sum(sign * pairs) / 2).alias("s"), (F.sum(F.when(F.col("x1") != F.col("x"), pairs).otherwise(0)) / 2).alias("px"), (F.sum(F.when(F.col("y1") != F.col("y"), pairs).otherwise(0)) / 2).alias("py"))
    return sums.select(*keys, "s", "px", "py", F.when((F.col("px") > 0) & (F.col("py") > 0), F.col("s") / F.sqrt(F.col("px") * F.col("py"))).alias("tau_b"))


def backfill(results: DataFrame, model: str, dataset: str, suffix: str = "-sd", other: str = "-md") -> DataFrame:
    """Models ending in ``suffix`` get their missing datasets from the twin ending in ``other``."""
    have = results.select(model, dataset)
    twins = results.where(F.col(model).endswith(other)).withColumn(model, F.regexp_replace(model, f"{other}$", suffix))
    known = have.where(F.col(model).endswith(suffix)).select(model).distinct()
    missing = twins.join(known, model, "left_semi").join(have, [model, dataset], "left_anti")
    return results.unionByName(missing.select(*results.columns))
