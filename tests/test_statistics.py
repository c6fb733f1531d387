"""Distributions, the accelerated bootstrap and tests over pairs of systems, against plain Python."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import distributions as dist
from spanloom.operators import bootstrap, metrics
from spanloom.operators.bootstrap import PRIME, bootstrap_bca, cell_counts


def column(spark, xs, *makers):
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", *[m(F.col("x")).alias(f"y{k}") for k, m in enumerate(makers)]).collect()
    return [{r["x"]: r[f"y{k}"] for r in rows} for k in range(len(makers))]


def test_normal(spark):
    xs = [0, -0.1, 0.5, 1, 1.96, -2.5, 2.999, 3.001, 4, 6, -8, 12, 30]
    tail, cdf = column(spark, xs, dist.normal_tail, dist.normal_cdf)
    for x in xs:
        assert tail[x] == pytest.approx(math.erfc(x / math.sqrt(2)) / 2, rel=1e-11)
        assert cdf[x] == pytest.approx(NormalDist().cdf(x), rel=1e-9)
    ps = [1e-300, 1e-20, 1e-5, 0.01, 0.07, 0.3, 0.5, 0.75, 0.95, 0.999999, 0, 1, -1]
    (z,) = column(spark, ps, dist.normal_quantile)
    for p in ps:
        assert z[p] is None if not 0 < p < 1 else z[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-12, abs=1e-15)


def test_student(spark):
    gamma, = column(spark, [0.5, 1, 2, 3.5, 10, 1000], dist.log_gamma)
    assert all(v == pytest.approx(math.lgamma(x), abs=1e-11, rel=1e-13) for x, v in gamma.items())
    for dof in (1, 2, 3, 10, 200, 5000):
        for p in (0.6, 0.9, 0.975, 0.9995):
            t = metrics.t_quantile(p, dof)
            (tail,) = column(spark, [t, -t], lambda x, dof=dof: dist.t_tail(x, F.lit(float(dof))))
            assert tail[t] == pytest.approx(1 - p, rel=1e-7) and tail[-t] == pytest.approx(p, rel=1e-7)
    (one,) = column(spark, [0, 3, 40], lambda x: dist.t_tail(x, F.lit(1.0)))
    assert all(v == pytest.approx(0.5 - math.atan(x) / math.pi, rel=1e-9) for x, v in one.items())


def plain_picks(seed, group, draw, n):
    import hashlib

    code = int(hashlib.md5(group.encode()).hexdigest()[:7], 16)
    out = []
    for i in range(n):
        x = (seed * 48271 + code + draw * 1583458089 + i * 784588716) % PRIME
        for _ in range(2):
            x = (x * x + 1226874159 * x + 1343714438) % PRIME
        out.append(x * n // PRIME)
    return out


def plain_bca(groups, draws, alpha=0.05, seed=42):
    """Draw by draw; the jackknife leaves out one row at a time."""
    macro = lambda gs: float(np.mean([np.mean(g) for g in gs]))
    data = [g for _, g in sorted(groups.items())]
    theta = macro(data)
    found = []
    for b in range(draws):
        found.append(macro([[g[i] for i in plain_picks(seed, name, b, len(g))] for name, g in sorted(groups.items())]))
    found = np.array(found)
    near = np.abs(found - theta) <= 1e-12 * abs(theta)
    z0 = NormalDist().inv_cdf((((found < theta) & ~near).sum() + 0.5 * near.sum()) / draws)
    top = bot = 0.0
    for j, g in enumerate(data):
        if len(g) > 1:
            left = np.array([macro([*data[:j], np.delete(g, i), *data[j + 1 :]]) for i in range(len(g))])
            top += ((left.mean() - left) ** 3).sum() / len(g) ** 3
            bot += ((left.mean() - left) ** 2).sum() / len(g) ** 2
    a = top / (6 * bot**1.5)
    level = lambda z: NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
    z = NormalDist().inv_cdf(alpha / 2)
    return theta, a, np.quantile(found, level(z)), np.quantile(found, level(-z))


def test_bca_like_a_plain_version(spark):
    rng = random.Random(3)
    groups = {"a": [rng.random() ** 3 for _ in range(40)], "b": [float(rng.random() < 0.2) for _ in range(25)], "c": [0.5]}
    rows = [("m", g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)] + [("n", "a", 1, None), ("n", "a", 2, 0.0)]
    df = spark.createDataFrame(rows, "model string, data string, id int, score double").repartition(5)
    got = {r["model"]: r for r in bootstrap_bca(df, "score", "data", "id", ["model"], draws=400).collect()}
    theta, a, low, high = plain_bca({f"m:{g}": xs for g, xs in groups.items()}, 400)
    r = got["m"]
    assert (r["macro"], r["acceleration"], r["low"], r["high"]) == pytest.approx((theta, a, low, high), rel=1e-9) and r["draws"] == 400
    assert (got["n"]["macro"], got["n"]["low"], got["n"]["high"], got["n"]["acceleration"]) == (0, 0, 0, 0)
    alone = bootstrap_bca(df.where("model = 'm'"), "score", "data", "id", draws=50).collect()
    assert len(alone) == 1 and alone[0]["low"] < theta < alone[0]["high"]
    assert bootstrap_bca(df.where("false"), "score", "data", "id", ["model"], draws=50).collect() == []


def test_cells_share_out_every_draw(spark, monkeypatch):
    """Split over many small cells, every draw still takes as many rows as the group has, and the spread is that of the mean."""
    sizes = [5, 9, 0, 7]
    tree = lambda cell: [21, sizes[cell & 2] + sizes[cell & 2 | 1], sizes[cell]]
    counts = [cell_counts(tree(c), c, 42, 7, 1000) for c in range(4) if sizes[c]]
    assert (sum(counts) == 21).all() and abs(counts[1].mean() - 9) < 0.2
    monkeypatch.setattr(bootstrap, "CELL_ROWS", 16)
    rng = np.random.default_rng(0)
    values = rng.normal(size=700)
    rows = [("g", int(i), float(x)) for i, x in enumerate(values)] + [("g", None, 1.0)] * 300
    df = spark.createDataFrame(rows, "data string, id int, score double").repartition(3)
    r = bootstrap_bca(df, "score", "data", "id", draws=2000).first()
    every = np.array([x for *_, x in rows])
    sd = every.std() / math.sqrt(len(every))
    assert r["macro"] == pytest.approx(every.mean()) and 0.45 < r["below"] < 0.55
    assert r["low"] == pytest.approx(every.mean() - 1.96 * sd, abs=0.15 * sd) and r["high"] == pytest.approx(every.mean() + 1.96 * sd, abs=0.15 * sd)


def test_large_groups_take_the_picks_of_sql(spark):
    """Groups beyond 4,096 rows, one with repeated rows, against the plain version draw by draw."""
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, 900, 5000).astype(float), "b": np.repeat(rng.integers(0, 900, 30).astype(float), 150)}
    rows = [("a", i, float(x)) for i, x in enumerate(groups["a"])] + [("b", i // 150, float(x)) for i, x in enumerate(groups["b"])]
    df = spark.createDataFrame(rows, "data string, id int, score double").repartition(3)
    sums = {(r["data"], r["draw"]): r["s"] for r in bootstrap.draw_sums(df, "score", ["data"], "id", 40, 42).select("data", "first", F.posexplode("sums").alias("k", "s")).selectExpr("data", "first + k as draw", "s").collect()}
    assert sums == {(g, b): v[plain_picks(42, g, b, len(v))].sum() for g, v in groups.items() for b in range(40)}
