"""Exact clustering: kd-tree filtering against plain Lloyd rounds in Python's integers, and the query's twin."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from spanloom.llm import centroids, queries
from spanloom.llm.centroids import build, cluster, walk, with_inertia

from .conftest import SMALL


def plain(rows, k, dims, rounds, scale=64):
    """(id, cluster, distance) sorted, and the centroids."""
    fit = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(fit, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, z: sum((a - b) ** 2 for a, b in zip(v, z, strict=True))
    nearest = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        mine = [[v for _, v in fit if nearest(v) == j] for j in range(len(c))]
        c = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else z for m, z in zip(mine, c, strict=True)]
    return sorted(((i, nearest(v), far(v, c[nearest(v)])) for i, v in fit), key=str), c


KIND = "vec_id long, embedding array<double>, label int, id string, cluster int, distance string"


def run(spark, rows, k=5, dims=3, rounds=3):
    df = spark.createDataFrame([(i, v, 0, "x", 9, "y") for i, v in rows], KIND)
    found, c = cluster(df.repartition(3), k=k, dims=dims, rounds=rounds)
    return found, c


@pytest.mark.parametrize("size,leaf", [(2048, 32), (16, 2), (7, 1)])
def test_like_plain_rounds(spark, monkeypatch, size, leaf):
    monkeypatch.setattr(centroids, "TREE_ROWS", size)
    monkeypatch.setattr(centroids, "LEAF_ROWS", leaf)
    rng = random.Random(size)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) if i % 3 else rng.gauss(i % 4, 0.2) for _ in range(3)]) for i in range(160)]
    rows += [(7, [1.0, 1.0, 1.0])] * 60 + [(None, [0.5, 0.5, 2.0])] * 2 + rows[:9]  # copies, repeats, null ids
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 0.0, 0.0]), (905, [float("-inf"), 0.0, 0.0]), (906, [1.0] * 4)]
    want, c = plain(rows, 5, 3, 3)
    found, got = run(spark, rows)
    assert got.tolist() == c
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == want


def test_large_numbers_stay_exact(spark):
    rows = [(i, [3.0e38 if i % 3 == 0 else -3.0e38 + i * 1e31, float(i), -(2.0 ** (i % 70))]) for i in range(60)]
    want, c = plain(rows, 4, 3, 2)
    found, got = run(spark, rows, k=4, rounds=2)
    assert [[int(x) for x in row] for row in got] == c
    assert sorted(((r["id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == sorted(((i, j, d if d < 1 << 63 else None) for i, j, d in want), key=str)
    assert with_inertia(found).select("inertia").distinct().collect()[0][0] is None


def test_few_vectors_and_none(spark):
    rows = [(1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0])]
    found, c = run(spark, rows, k=5)
    want, plain_c = plain(rows, 5, 3, 3)
    assert c.tolist() == plain_c and sorted(map(tuple, found.collect()), key=str) == want
    found, c = run(spark, [(1, None)])
    assert len(c) == 0 and with_inertia(found).collect() == []


def test_whole_nodes_are_assigned():
    """Where groups lie apart, filtering settles inner nodes without looking at their vectors."""
    rng = np.random.default_rng(1)
    middle = rng.integers(-4000, 4000, size=(8, 16))
    x = np.concatenate([m + rng.integers(-20, 20, size=(256, 16)) for m in middle]).astype(np.int64)
    tree, order = build(x)
    assert sorted(order.tolist()) == list(range(len(x)))
    parts = list(walk(tree, middle.astype(np.int64)))
    assert sum(hi - lo for lo, hi, *_ in parts) == len(x)
    inner = sum(hi - lo for lo, hi, j, node in parts if isinstance(j, int) and tree.left[node] >= 0)
    assert inner > len(x) // 2


def test_query_is_its_twin(spark):
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    out = db.execute(queries.ORACLE["op12_centroids"])
    names = [d[0] for d in out.description]
    df = queries.op12_centroids(spark, SMALL)
    assert sorted(names) == sorted(df.columns)
    assert sorted(df.select(*names).collect()) == sorted(map(tuple, out.fetchall()))
