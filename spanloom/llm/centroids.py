"""Centroid clustering (12): exact k-means by kd-tree filtering.

Vectors become integers, floor(scale * x), and go into kd-trees, one per ``TREE_ROWS`` vectors of a partition. A node holds
its vectors' count, integer sums and box. In a round the centroids walk down each tree: a centroid is dropped from a node
when another one is strictly nearer to every point of its box (then it is no vector's nearest, ties included); a node with
one centroid left is assigned as a whole by its count and sums; leaves are resolved vector by vector. The trees are built
once and written to the shared folder, so a round reads them and sends ``k x dims`` sums a task; only the centroids, whose
size is fixed by the parameters, come to the driver.

All arithmetic is exact: doubles while products stay below 2^53, 64-bit integers while they stay below 2^63, Python's
integers beyond. Vectors that are null, of another length, or hold a null or non-finite component are left out, as is one
beyond ``LARGEST`` (no float reaches it). Equal distances go to the smaller centroid. With fewer vectors than ``k`` there are
fewer centroids; without any there are no rows. Repeated rows count as often as they stand; the starting order is by the
hash of the id (null as the empty string), then by the vector. Squared distances and inertias beyond 64 bits are null.
Copies of one vector make a leaf of any size up to a tree's. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Vectors of a tree and of a leaf. A tree's row in the written table has about ``TREE_ROWS * dims * 8`` bytes at most.
TREE_ROWS, LEAF_ROWS = 2048, 32
#: Components from here on are no float's.
LARGEST = 2.0**150
#: Sums travel as five limbs of 32 bits, the last one signed.
LIMBS = 5


def largest(x: np.ndarray) -> int:
    return int(max(abs(int(x.max())), abs(int(x.min())))) if x.size else 0


def fitting(x: np.ndarray, most: int, terms: int) -> np.ndarray:
    """``x`` in the cheapest type in which ``terms`` products of differences of numbers up to ``most`` are exact."""
    bound = 4 * most * most * max(terms, 1)
    return x.astype(np.float64) if bound < 1 << 53 else x.astype(np.int64) if bound < 1 << 63 else x.astype(object)


def whole(x: list[float], scale: int) -> np.ndarray:
    """floor(scale * x), exact for every finite double."""
    y = np.floor(np.asarray(x, dtype=np.float64) * scale)
    return y.astype(np.int64) if not y.size or np.abs(y).max() < 2.0**50 else np.array([int(v) for v in y.ravel()], dtype=object).reshape(y.shape)


@dataclass
class Tree:
    """Vectors in tree order; node j covers rows ``lo[j]`` to ``hi[j]`` and has children ``left[j]`` and ``left[j] + 1`` (-1: a leaf)."""

    x: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray


def build(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over the rows of ``x`` and the order in which it holds them; nodes split at the median of their widest side."""
    order = np.arange(len(x))
    lo, hi, left, low, high, sums, at = [0], [len(x)], [], [], [], [], 0
    while at < len(lo):
        rows = order[lo[at] : hi[at]]
        part = x[rows]
        small, large = part.min(axis=0), part.max(axis=0)
        low.append(small)
        high.append(large)
        sums.append(part.sum(axis=0))
        side = int(np.argmax(large - small))
        if len(rows) <= LEAF_ROWS or small[side] == large[side]:
            left.append(-1)
        else:
            half = len(rows) // 2
            order[lo[at] : hi[at]] = rows[np.argsort(part[:, side], kind="stable")]
            left.append(len(lo))
            lo += [lo[at], lo[at] + half]
            hi += [lo[at] + half, hi[at]]
        at += 1
    return Tree(x[order], np.array(lo), np.array(hi), np.array(left), np.array(low), np.array(high), np.array(sums)), order


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact if :func:`fitting` chose the types."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def undominated(low: np.ndarray, high: np.ndarray, c: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The centroids among ``left`` that may be nearest to a point of the box.

    The one nearest to the box's middle drops z if it is strictly nearer than z even to the corner that lies farthest towards z.
    """
    some = c[left]
    middle = low + high  # twice the middle, so that it stays whole
    gap = ((2 * some - middle) ** 2).sum(axis=1)
    best = int(np.argmin(gap))
    corner = np.where(some > some[best], high, low)
    mine, theirs = ((corner - some[best]) ** 2).sum(axis=1), ((corner - some) ** 2).sum(axis=1)
    keep = mine >= theirs
    keep[best] = True
    return left[keep]


def walk(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
    """``(lo, hi, cluster or clusters, node)``: rows of the tree with their nearest centroid; a whole node has one number."""
    most = max(largest(tree.x), largest(centroids))
    dims = tree.x.shape[1]
    x, c = fitting(tree.x, most, dims), fitting(centroids, most, dims)
    wide = fitting(centroids, 2 * most, dims)  # the middle of a box is taken twice
    low, high = (fitting(b, 2 * most, dims) for b in (tree.low, tree.high))
    todo = [(0, np.arange(len(c)))]
    while todo:
        node, left = todo.pop()
        left = undominated(low[node], high[node], wide, left)
        lo, hi = int(tree.lo[node]), int(tree.hi[node])
        if len(left) == 1:
            yield lo, hi, int(left[0]), node
        elif tree.left[node] < 0:
            yield lo, hi, left[np.argmin(distances(x[lo:hi], c[left]), axis=1)], node
        else:
            child = int(tree.left[node])
            todo += [(child, left), (child + 1, left)]


def pack(x: np.ndarray) -> bytes:
    """Integers in the smallest of 32 and 64 bits, or as text beyond."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel())).encode()
    return b"i" + x.astype(np.int32).tobytes() if largest(x) < 1 << 31 else b"l" + x.astype(np.int64).tobytes()


def unpack(raw: bytes, dims: int) -> np.ndarray:
    kind, rest = raw[:1], raw[1:]
    if kind == b"t":
        return np.array([int(v) for v in rest.split(b",")], dtype=object).reshape(-1, dims)
    return np.frombuffer(rest, dtype=np.int32 if kind == b"i" else np.int64).astype(np.int64).reshape(-1, dims)


TREE_COLUMNS = ["x", "nodes", "low", "high", "sums"]


def tree_of(row: dict, dims: int) -> Tree:
    lo, hi, left = np.frombuffer(row["nodes"], dtype=np.int64).reshape(3, -1)
    return Tree(unpack(row["x"], dims), lo, hi, left, *(unpack(row[k], dims) for k in ("low", "high", "sums")))


def plant(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """One row a tree: ``(ids, x, nodes, low, high, sums)`` from ``vectors(id, v)`` that are all fit."""
    schema = T.StructType([T.StructField("ids", T.ArrayType(vectors.schema["id"].dataType)), *[T.StructField(k, T.BinaryType()) for k in TREE_COLUMNS]])

    def run(batches):
        ids, parts, held = [], [], 0

        def row():
            every, x = pa.concat_arrays(ids), np.concatenate(parts)
            tree, order = build(x)
            blobs = [pack(tree.x), np.stack([tree.lo, tree.hi, tree.left]).astype(np.int64).tobytes(), pack(tree.low), pack(tree.high), pack(tree.sums)]
            listed = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), every.take(pa.array(order)))
            return pa.RecordBatch.from_arrays([listed, *[pa.array([b], pa.binary()) for b in blobs]], ["ids", *TREE_COLUMNS])

        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                part = batch.slice(lo, TREE_ROWS - held)
                lo, held = lo + part.num_rows, held + part.num_rows
                ids.append(part.column(0))
                parts.append(whole(part.column(1).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dims))
                if held == TREE_ROWS:
                    yield row()
                    ids, parts, held = [], [], 0
        if held:
            yield row()

    return vectors.mapInArrow(run, schema)


def limbs(value: int) -> list[int]:
    return [value >> 32 * k & 0xFFFFFFFF for k in range(LIMBS - 1)] + [value >> 32 * (LIMBS - 1)]


def round_sums(trees: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """Rows ``(cluster, dim, l0 ..)`` of all tasks, added up: sums per cluster and component, and its count as component -1."""

    def run(batches):
        k = len(centroids)
        count, sums = [0] * k, np.zeros((k, dims), dtype=object)
        for batch in batches:
            for row in batch.to_pylist():
                tree = tree_of(row, dims)
                part = np.zeros((k, dims), dtype=tree.sums.dtype)
                for lo, hi, cluster, node in walk(tree, centroids):
                    if isinstance(cluster, int):
                        count[cluster] += hi - lo
                        part[cluster] += tree.sums[node]
                    else:
                        for j in np.unique(cluster).tolist():
                            mine = cluster == j
                            count[j] += int(mine.sum())
                            part[j] += tree.x[lo:hi][mine].sum(axis=0)
                sums = sums + part
        rows = [(j, d, *limbs(int(v))) for j in range(k) if count[j] for d, v in [(-1, count[j]), *enumerate(sums[j])]]
        kinds = [pa.int32(), pa.int32(), *[pa.int64()] * LIMBS]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["cluster", "dim", *[f"l{i}" for i in range(LIMBS)]])

    parts = trees.select(*TREE_COLUMNS).mapInArrow(run, "cluster int, dim int, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    return parts.groupBy("cluster", "dim").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)])


def moved(trees: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """The centroids after a round: the floor of each mean; an empty one stays."""
    found: dict[tuple[int, int], int] = {}
    for r in round_sums(trees, centroids, dims).collect():  # k x (dims + 1) rows
        found[r["cluster"], r["dim"]] = sum(r[f"l{i}"] << 32 * i for i in range(LIMBS))
    rows = [[found[j, d] // found[j, -1] for d in range(dims)] if (j, -1) in found else [int(v) for v in centroids[j]] for j in range(len(centroids))]
    return slim(rows)


def slim(rows: list[list[int]]) -> np.ndarray:
    out = np.array(rows, dtype=object)
    return out.astype(np.int64) if largest(out) < 1 << 62 else out


def assigned(trees: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""
    schema = T.StructType([T.StructField("id", trees.schema["ids"].dataType.elementType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                tree = tree_of(row.select(TREE_COLUMNS).to_pylist()[0], dims)
                cluster = np.zeros(len(tree.x), dtype=np.int32)
                for lo, hi, found, _ in walk(tree, centroids):
                    cluster[lo:hi] = found
                most = max(largest(tree.x), largest(centroids))
                gap = fitting(tree.x, most, dims) - fitting(centroids, most, dims)[cluster]
                far = [v if v < 1 << 63 else None for v in map(int, (gap * gap).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), pa.array(cluster), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, schema)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` finite components."""
    fine = lambda v: v.isNotNull() & (F.abs(v) < LARGEST)  # noqa: E731  false for NaN, which is above every number
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda v: fine(v.cast("double"))), F.lit(False))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """Every vector's ``(id, cluster, distance)`` as a written table, and the final centroids.

    Centroids start as the ``k`` vectors with the smallest hash of ``seed:id``, in that order.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = vectors.where(usable(F.col(vector_col), dims)).select(F.col(id_col).alias("id"), v.alias("v"))
    start = fit.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)).orderBy("h", "v").limit(k).collect()
    if not start:
        return assigned(plant(fit, dims, scale), np.zeros((1, dims), dtype=np.int64), dims), np.zeros((0, dims), dtype=np.int64)
    centroids = slim([[math.floor(scale * x) for x in r["v"]] for r in start])
    trees = scratch.save(plant(fit, dims, scale), "trees")
    for _ in range(rounds):
        centroids = moved(trees, centroids, dims)
    out = scratch.save(assigned(trees, centroids, dims), "assigned")
    scratch.drop(trees)
    return out, centroids


def with_inertia(found: DataFrame) -> DataFrame:
    """``found`` with ``cluster_inertia`` and ``inertia``: distances summed over a cluster and over all; null beyond 64 bits."""
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(19,0)"))).alias("s")
    each = found.groupBy("cluster").agg(total)
    every = each.agg(F.when(F.count("*") == F.count("s"), F.sum("s")).alias("t"))
    sums = each.join(F.broadcast(every)).select("cluster", F.col("s").try_cast("long").alias("cluster_inertia"), F.col("t").try_cast("long").alias("inertia"))
    return found.join(F.broadcast(sums), "cluster")  # a row a cluster
