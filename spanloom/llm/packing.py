"""Packing (10): optimal length buckets and token-budget batches.

The global histogram of lengths has at most 64 cells per doubling of the length
(short lengths are exact), so its size is bounded whatever the corpus: about
2,200 cells up to 2^40 tokens. Dynamic programming over the cells chooses the
bucket boundaries with the least padding, where every row of a bucket is padded
to the bucket's longest row. Inside a bucket, rows form batches of
``budget // boundary`` rows; rows longer than the budget form batches of one.

Row numbers inside a bucket come from counts: rows fall into groups of bounded
expected size by a hash of the id, the groups' counts give each group its first
number, and only rows of one group are ever numbered together. A bucket with a
third of all rows is therefore spread over many tasks.

A null, empty or blank text has no tokens and is packed like any other length.
Rows that repeat an id get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import pieces
from .scratch import Scratch


def count_words(texts: pa.Array) -> np.ndarray:
    """Words (runs outside space and 0x09-0x0D) of each text."""
    return np.array([len(t.split()) if t else 0 for t in texts.cast(pa.binary()).to_pylist()], dtype=np.int64)


def bpe_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """A counter for a tokenizer file of the ``tokenizers`` library at ``path`` (readable on every executor)."""
    loaded: list = []

    def count(texts: pa.Array) -> np.ndarray:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
            loaded[0].encode_special_tokens = True
        return np.array([len(e.ids) for e in loaded[0].encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)], dtype=np.int64)

    return count


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counter: Callable[[pa.Array], np.ndarray] = count_words) -> DataFrame:
    """``(doc_id, n_tokens)`` per row."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counter(piece.column(1)), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def cell(n: str = "n_tokens"):
    """The histogram cell of a length: itself below 128, else rounded up to one of 64 steps per doubling."""
    step = f"shiftleft(1L, greatest(0, cast(floor(log2(greatest({n}, 1))) as int) - 6))"
    return F.expr(f"cast(ceil({n} / {step}) as long) * {step}")


def boundaries(counts: np.ndarray, longest: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets over cells in ascending order that minimise the padding."""
    m = len(counts)
    if not m:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(total)])
    best = np.full(m + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(buckets, m)):
        new, arg = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        new[0] = 0
        for j in range(1, m + 1):  # cells i..j-1 form the last bucket
            cost = best[:j] + float(longest[j - 1]) * (c[j] - c[:j]) - (s[j] - s[:j])
            arg[j] = np.argmin(cost)
            new[j] = cost[arg[j]]
        best = new
        back.append(arg)
    out, j = [], m
    for arg in reversed(back):
        if j == 0:
            break
        out.append(int(longest[j - 1]))
        j = int(arg[j])
    return sorted(out)


def pack(lengths: DataFrame, buckets: int = 16, budget: int = 65536, group_rows: int = 1 << 15) -> DataFrame:
    """``(doc_id, n_tokens, bucket, batch, slot)`` per row of ``lengths(doc_id, n_tokens)``; bucket is its padded length."""
    spark = lengths.sparkSession
    lengths = Scratch(spark, "pack").save(lengths.select("doc_id", "n_tokens"), "lengths")
    histogram = lengths.groupBy(cell().alias("cell")).agg(F.count("*").alias("c"), F.max("n_tokens").alias("m"), F.sum("n_tokens").alias("s")).orderBy("cell").collect()
    edges = boundaries(*(np.array([r[k] for r in histogram], dtype=np.int64) for k in ("c", "m", "s")), buckets)
    groups = max(1, sum(r["c"] for r in histogram) // group_rows)
    if not edges:
        return lengths.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("slot"))
    bounds = F.array(*[F.lit(e).cast("long") for e in edges])
    rows = lengths.withColumn("bucket", F.array_min(F.filter(bounds, lambda e: e >= F.col("n_tokens"))))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    counts = rows.groupBy("bucket", "g").count()
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("bucket", "g", F.coalesce(before, F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("bucket", "g").orderBy("doc_id", "n_tokens")) - 1
    rows = rows.withColumn("number", number).join(first, ["bucket", "g"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket", F.lit(1)))).cast("long")
    at = F.col("number") + F.col("first")
    return rows.select("doc_id", "n_tokens", "bucket", F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot"))
