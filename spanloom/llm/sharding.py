"""Sharding (9) by extendible hashing.

Rows hash to 60 bits. A directory indexed by the leading bits starts with one
bucket; only a bucket over its byte limit splits on the next bit, so hot hash
ranges get long prefixes and the rest stay coarse. Cells (leading ``bits`` of the
hash) are summed once; all prefixes of a cell are summed from the cells, and a
cell belongs to its shortest prefix that fits. Only cells that are still too
large are summed again with more bits. Rows whose whole hashes agree (repeated
ids) cannot be told apart by bits: in such a bucket rows over half the limit get
shards of their own, and the others are cut into runs by a running sum of bytes
in steps of the limit less the largest of them, so that no run exceeds it. Only
a single row over the limit makes a shard over it.

Everything runs as DataFrame operations; the directory is never collected.

A null or empty text counts 0 bytes; null ids hash like the empty string. Rows
and columns are kept as they are, whatever their names (a column of ours whose
name is taken gets underscores); an empty table gives no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

BITS = 60


def hash_bits(key: Column) -> Column:
    """60 bits of the key's MD5, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: Column | str, depth: Column) -> Column:
    """The leading ``depth`` bits of a hash."""
    return F.expr(f"shiftright({h}, {BITS} - cast({depth} as int))")


def directory(sizes: DataFrame, limit: int, step: int, scratch: Scratch) -> DataFrame:
    """``(depth, prefix)`` of each bucket from ``sizes(h, n_bytes)``."""
    found, rest, lo = None, sizes, 0
    while True:
        hi = min(lo + step, BITS)
        cells = rest.groupBy(prefix("h", hi).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        over = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("depth"))
        over = over.withColumn("prefix", F.expr(f"shiftright(cell, {hi} - depth)"))
        sums = over.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("total"))
        # The parent of a bucket does not fit; the root and, at the last bit, what cannot split further stay.
        big = sums.where(F.col("total") > limit).select(F.col("depth").alias("d"), F.col("prefix").alias("p"))
        fits = sums.where((F.col("total") <= limit) | (F.col("depth") == BITS))
        at_root = fits.where(F.col("depth") == lo) if lo == 0 else fits.where("false")
        split = fits.where(F.col("depth") > lo).join(big, (F.col("depth") == F.col("d") + 1) & (F.expr("shiftright(prefix, 1)") == F.col("p")), "left_semi")
        level = scratch.save(at_root.unionByName(split).select("depth", "prefix"), "buckets")
        found = level if found is None else found.unionByName(level)
        if hi == BITS:
            return found
        more = scratch.save(sums.where((F.col("depth") == hi) & (F.col("total") > limit)).select("prefix"), "big")
        if not more.limit(1).count():
            return found
        rest = scratch.save(rest.withColumn("prefix", prefix("h", hi)).join(more, "prefix", "left_semi").drop("prefix"), "rest")
        lo = hi


def shard_names(columns: list[str]) -> list[str]:
    """The names of depth, prefix and part beside ``columns``."""
    taken = {c.lower() for c in columns}
    names = []
    for name in ("depth", "prefix", "part"):
        while name in taken:
            name += "_"
        names.append(name)
    return names


def parts(last: DataFrame, limit: int) -> DataFrame:
    """``last(prefix, n_bytes, tie, ...)`` with a ``part`` whose bytes stay within the limit, or that is one row."""
    whole = Window.partitionBy("prefix")
    order = whole.orderBy("n_bytes", "tie")
    small = F.col("n_bytes") * 2 <= limit
    out = last.withColumn("step", F.lit(limit) - F.coalesce(F.max(F.when(small, F.col("n_bytes"))).over(whole), F.lit(0)))
    out = out.withColumn("before", F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("run", F.when(small, F.expr("before div step")))
    # Ordered by size, the large rows come after all runs.
    rank = F.sum(F.when(small, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    alone = F.coalesce(F.max("run").over(whole), F.lit(-1)) + rank
    return out.withColumn("part", F.coalesce(F.col("run"), alone).cast("long")).drop("step", "before", "run")


def shard_rows(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """All rows and columns with the depth, prefix and part (:func:`shard_names`) that are their shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    sizes = scratch.save(docs.select(n_bytes, hash_bits(F.col(id_col)).alias("h")), "sizes")
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    step = bits or min(BITS, max(4, (max(1, total // max(1, limit))).bit_length() + 3))
    buckets = scratch.save(directory(sizes, limit, step, scratch), "directory")
    # A row finds its bucket by an equi-join on the leading bits of each depth in use.
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # 61 at most
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, n_bytes, hash_bits(F.col(id_col)).alias("h"), F.xxhash64(text_col).alias("tie"))
    placed = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))) if depths else rows.withColumn("depth", F.lit(0))
    placed = placed.withColumn("prefix", prefix("h", "depth")).join(buckets, ["depth", "prefix"])
    out = placed.where(F.col("depth") < BITS).withColumn("part", F.lit(0).cast("long"))
    if BITS in depths:
        # Equal hashes at the last bit are cut by bytes.
        out = out.unionByName(parts(placed.where(F.col("depth") == BITS), limit))
    ours = [F.col(c).cast("long").alias(n) for c, n in zip(("depth", "prefix", "part"), shard_names(docs.columns), strict=True)]
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *ours)


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """Writes each shard as one Parquet file of all its rows and columns, in folders depth/prefix/part, and reads them back."""
    out, names = shard_rows(docs, limit, id_col, text_col, bits), shard_names(docs.columns)
    out.repartition(*names).write.option("maxRecordsPerFile", 0).partitionBy(*names).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def listed(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, depth, prefix, part)`` of sharded rows."""
    ours = [F.col(n).alias(c) for c, n in zip(("depth", "prefix", "part"), rows.columns[-3:], strict=True)]
    return rows.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), *ours)


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, depth, prefix, part)`` per row, without files; a shard is (depth, prefix, part)."""
    return listed(shard_rows(docs, limit, id_col, text_col, bits), id_col, text_col)
