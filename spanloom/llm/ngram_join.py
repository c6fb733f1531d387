"""N-gram Jaccard join (7): a blocked sparse product of documents by n-grams.

The incidence matrix has a row for each distinct shingle set and a column for
each 5-word shingle. Multiplying it by its transpose gives the overlap counts.
Only entries that can reach the bound are multiplied:

* equal sets are one row, found by a fingerprint of the set;
* in a global order (rare columns first) two sets with Jaccard >= t share l
  columns among the first ``n - ceil(t n) + l`` of each, so other entries stay out,
  and so do sets that share fewer with all others together;
* columns are dealt to blocks by hash; a block multiplies its columns and keeps
  the cells whose sizes satisfy ``t max(n, m) <= min(n, m)``;
* a cell that stays gets its whole overlap counted from both rows.

Documents sharing a column are first held against a hub, the member that shares
most of its columns (the source of a group of copies does). Members that are still
in different components are then multiplied tile by tile inside a task, which
emits a spanning forest of the links and never pairs, so no link between
components is lost and a group of g near copies sends about g rows.

The column order is by counts of hashed columns in a fixed-size table; columns
that turn out crowded among the prefixes (passages that many texts quote) move to
the end of the order before the product. The order only steers cost: the result
is the same for any.

Null, empty and blank texts have no shingles and are linked with nothing; a text
of one to four words is one shingle. Repeated rows keep their own output row.
Repeated ``doc_id`` values are the caller's to avoid: the component is named by
the smallest id. Columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .hashing import U, Words, from_planes, grams, mix, pieces, planes
from .scratch import Scratch, parallelism

#: Cells of the table of column counts: its size is fixed, whatever the corpus.
COLUMN_BITS = 22
PART_BITS = 18
#: A column in so many prefixes is crowded: it moves behind all others in the order.
CROWD = 6
#: Rows and shingles that a tile of the last product has at most, as expected numbers.
TILE_ROWS, TILE_SHINGLES = 400, 1 << 20


def shingle_sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; empty without words."""
    for piece in pieces(batch, column):
        words = Words(piece.column(piece.schema.get_field_index(column)), lower=True)
        whole = grams(words.hash, k)
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if hi - lo >= k:
                yield np.unique(whole[lo : hi - k + 1])
            else:
                yield grams(words.hash[lo:hi], hi - lo) if hi > lo else whole[:0]


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit fingerprint of a shingle set."""
    size = np.full(1, len(shingles), dtype=U)
    return int(mix(np.sum(mix(shingles), dtype=U, keepdims=True) + size * U(0x9E3779B97F4A7C15)).view(np.int64)[0])


def needed(n, share: int):
    """The least overlap with any set: ceil(share/100 * n)."""
    return -((-share * n) // 100)


def spare(n):
    """How many columns of its prefix a set must share to be linked at all; its prefix is longer by as many less one.

    Of sets that overlap in o columns, the first ``n - o + l`` of each share l at least.
    """
    return 1 + n // 32


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows ``(doc_id, id, n, part, blob)``: one a document (part null), and counts of hashed columns by part."""

    def run(batches):
        flat, held = [], 0
        counts = np.zeros(1 << COLUMN_BITS, dtype=np.uint32)
        for batch in batches:
            ids, ns = [], []
            for s in shingle_sets(batch, "text", k):
                ids.append(set_id(s) if len(s) else None)
                ns.append(len(s))
                flat.append((s >> U(64 - COLUMN_BITS)).astype(np.uint32))
                held += len(s)
                if held > 1 << 22:
                    counts += np.bincount(np.concatenate(flat), minlength=1 << COLUMN_BITS).astype(np.uint32)
                    flat, held = [], 0
            m = len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], ["doc_id", "id", "n", "part", "blob"])
        if flat:
            counts += np.bincount(np.concatenate(flat), minlength=1 << COLUMN_BITS).astype(np.uint32)
        if counts.any():
            parts = counts.reshape(-1, 1 << PART_BITS)
            m = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()), pa.array([zlib.compress(planes(p), 1) for p in parts], pa.binary())], ["doc_id", "id", "n", "part", "blob"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, id long, n long, part int, blob binary")


def column_counts(profiled: DataFrame) -> np.ndarray:
    """The summed table of column counts: ``1 << COLUMN_BITS`` numbers, whatever the corpus."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << PART_BITS, dtype=np.uint64)
        for blob in table.column("blob"):
            total += from_planes(zlib.decompress(blob.as_py()), np.uint32)
        return pa.table({"part": table.column("part").slice(0, 1), "blob": pa.array([zlib.compress(planes(np.minimum(total, 0xFFFFFFFF).astype(np.uint32)), 1)], pa.binary())})

    blobs = profiled.where("part is not null").select("part", "blob", (F.xxhash64("blob") % 16).alias("some"))
    some = blobs.groupBy("part", "some").applyInArrow(lambda t: add(t), "part int, blob binary")
    whole = some.groupBy("part").applyInArrow(lambda t: add(t), "part int, blob binary")
    counts = np.zeros(1 << COLUMN_BITS, dtype=np.uint32)
    for row in whole.toLocalIterator():
        counts[row["part"] << PART_BITS : (row["part"] + 1) << PART_BITS] = from_planes(zlib.decompress(row["blob"]), np.uint32)
    return counts


def prefix_entries(docs: DataFrame, counts, blocks: int, k: int, share: int, named: bool = True) -> DataFrame:
    """Rows ``(block, columns, ids, sizes)``: the entries of each set's prefix, packed by block.

    Without ``named``, ids and sizes are null.
    """

    def run(batches):
        order, seen, held, size = counts.value, set(), [], 0

        def flush():
            cols, ids, ns = (np.concatenate([h[j] for h in held]) for j in range(3))
            block = (mix(cols ^ U(0x5851F42D4C957F2D)) >> U(33)) % U(blocks)
            at = np.argsort(block, kind="stable")
            cols, ids, ns = cols[at], ids[at], ns[at]
            ends = np.cumsum(np.bincount(block.astype(np.int64), minlength=blocks))
            rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if hi > lo]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32())] + [pa.array([planes(x[lo:hi]) if named or x is cols else None for _, lo, hi in rows], pa.binary()) for x in (cols, ids, ns)],
                ["block", "columns", "ids", "sizes"],
            )

        for batch in batches:
            for s in shingle_sets(batch, "text", k):
                n = len(s)
                if not n or (name := set_id(s)) in seen:
                    continue
                seen.add(name)
                rare = np.lexsort((s, order[(s >> U(64 - COLUMN_BITS)).astype(np.int64)]))[: n - needed(n, share) + spare(n)]
                held.append((s[rare], np.full(len(rare), name, dtype=np.int64), np.full(len(rare), n, dtype=np.uint32)))
                size += len(rare)
                if size > 1 << 20:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "block int, columns binary, ids binary, sizes binary")


def multiply(entries: DataFrame, share: int) -> DataFrame:
    """The cells of a block, as runs: rows ``(run, id, n)`` for the members of each column with two sets or more
    (one run for equal members) and rows ``(null, id, columns)`` with the number of such columns of a set."""

    def block(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([from_planes(x.as_py(), kind) for x in table.column(c)])
        cols, ids, ns = read("columns", U), read("ids", np.int64), read("sizes", np.uint32).astype(np.int64)
        at = np.lexsort((ids, cols))
        cols, ids, ns = cols[at], ids[at], ns[at]
        fresh = np.ones(len(cols), dtype=bool)
        fresh[1:] = (cols[1:] != cols[:-1]) | (ids[1:] != ids[:-1])
        cols, ids, ns = cols[fresh], ids[fresh], ns[fresh]
        first = np.flatnonzero(np.concatenate([[True], cols[1:] != cols[:-1]]))
        length = np.diff(np.concatenate([first, [len(cols)]]))
        name = mix(np.add.reduceat(mix(ids.view(U)), first)).view(np.int64)
        keep = length >= 2
        degree_ids, degree = np.unique(ids[np.repeat(keep, length)], return_counts=True)
        _, one = np.unique(name[keep], return_index=True)  # the same members meet in many columns: one run is enough
        first, length, name = first[keep][one], length[keep][one], name[keep][one]
        member = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))
        run = pa.concat_arrays([pa.array(np.repeat(name, length), pa.int64()), pa.nulls(len(degree_ids), pa.int64())])
        return pa.table({"run": run, "id": np.concatenate([ids[member], degree_ids]), "n": np.concatenate([ns[member], degree]).astype(np.int64)})

    return entries.groupBy("block").applyInArrow(lambda t: block(t), "run long, id long, n long")


def demote(counts: np.ndarray, entries: DataFrame) -> tuple[np.ndarray, int]:
    """The counts with crowded columns (in ``CROWD`` prefixes or more) placed after all others, and how many cells they fill."""

    def block(table: pa.Table) -> pa.Table:
        cols, n = np.unique(np.concatenate([from_planes(x.as_py(), U) for x in table.column("columns")]), return_counts=True)
        cols, n = cols[n >= CROWD], n[n >= CROWD]
        return pa.table({"cell": (cols >> U(64 - COLUMN_BITS)).astype(np.int32), "n": n.astype(np.int64)})

    cells = entries.select("block", "columns").groupBy("block").applyInArrow(lambda t: block(t), "cell int, n long").groupBy("cell").agg(F.max("n").alias("n"))
    out, k = np.minimum(counts, (1 << 20) - 1).astype(np.uint32), 0
    for row in cells.toLocalIterator():  # 1 << COLUMN_BITS rows at most
        out[row["cell"]] += np.uint32(min(row["n"], 4095)) << np.uint32(20)
        k += 1
    return out, k


def overlaps(cells: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """The cells ``(a, b)`` whose whole overlap reaches the bound, each from both rows' sets."""

    def count(batches):
        last, mine = None, None
        for batch in batches:
            for piece in pieces(batch, "text_b"):
                a, b = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                keep = []
                for i, other in enumerate(shingle_sets(piece, "text_b", k)):
                    if a[i] != last:
                        last, mine = a[i], next(shingle_sets(piece.slice(i, 1), "text_a", k))
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    keep.append(100 * both >= share * (len(mine) + len(other) - both))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, y in zip(a, keep, strict=True) if y], pa.int64()), pa.array([x for x, y in zip(b, keep, strict=True) if y], pa.int64())], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return cells.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(count, "a long, b long")


def tile_products(dealt: DataFrame, k: int, share: int) -> DataFrame:
    """Links ``(a, b)`` that join labels within each tile ``(hub, i, j)``: rows of tile i times rows of tile j.

    The product runs over blocks of shared columns and accumulates overlap counts;
    only links are emitted, and of those one spanning forest of the tile.
    """

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        i, j, mine = (table.column(c).to_numpy() for c in ("i", "j", "tile"))
        texts = pa.record_batch({"text": table.column("text").chunk(0) if table.num_rows else pa.array([], pa.string())})
        sets = list(shingle_sets(texts, "text", k))
        n = np.array([len(x) for x in sets], dtype=np.int64)
        columns, where = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(where) >= 2
        rank = np.cumsum(often) - 1
        row = np.repeat(np.arange(len(sets)), n)[often[where]]
        col = rank[where[often[where]]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        counts = np.zeros((len(sets), len(sets)), dtype=np.float32)
        width = 2048
        edges = np.searchsorted(col, np.arange(0, int(often.sum()) + width, width))
        for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if hi > lo:
                dense = np.zeros((len(sets), width), dtype=np.float32)
                dense[row[lo:hi], col[lo:hi] - b * width] = 1
                counts += dense @ dense.T
        linked = np.triu(100 * counts >= share * (n[:, None] + n[None, :] - counts), 1) & (labels[:, None] != labels[None, :])
        if len(i) and i[0] != j[0]:
            linked &= mine[:, None] != mine[None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        out = []
        for x, y in np.argwhere(linked).tolist():
            u, v = find(int(labels[x])), find(int(labels[y]))
            if u != v:
                root[max(u, v)] = min(u, v)
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return dealt.groupBy("hub", "i", "j").applyInArrow(lambda t: tile(t), "a long, b long")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, share: int = 80, block_entries: int = 1 << 19) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs``; links need Jaccard >= share/100."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiled = scratch.save(profile(docs, k), "profile")
    sets = profiled.where("part is null").select("doc_id", "id", "n")
    rows = sets.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    entries = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(64, parallelism(spark), -(-entries * (100 - share) // 100 // block_entries))

    # Shared passages leave the prefixes of texts that have anything rarer.
    counts = spark.sparkContext.broadcast(column_counts(profiled))
    order, _ = demote(counts.value, prefix_entries(docs, counts, blocks, k, share, named=False))
    counts.unpersist()
    order = spark.sparkContext.broadcast(order)
    product = scratch.save(multiply(prefix_entries(docs, order, blocks, k, share), share), "product")
    order.unpersist()

    members = product.where("run is not null").distinct()
    degree = product.where("run is null").groupBy("id").agg(F.sum("n").alias("columns"))
    runs = members.join(degree, "id").where("columns >= 1 + floor(n / 32)").select("run", "id", "n", (F.col("columns") / F.col("n")).alias("shared"))
    hubs = runs.groupBy("run").agg(F.max(F.struct("shared", "id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("run", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    held = scratch.save(runs.join(hubs, "run").where("id <> hub").select("run", "hub", "hub_n", "id", "n"), "held")
    involved = held.select("id").unionByName(held.select(F.col("hub").alias("id"))).distinct()
    texts = scratch.save(docs.join(rows.join(involved, "id", "left_semi").select("doc_id", "id"), "doc_id").select("id", "text"), "texts")
    # Each run is held against its hub, the member with the most shared columns for its size.
    cells = held.where(F.expr(f"{share} * greatest(n, hub_n) <= 100 * least(n, hub_n)")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.save(overlaps(cells, texts, k, share), "links")
    labels = connected_components(links, scratch)

    # The members of all runs of one hub that are still apart are multiplied with each other, in tiles.
    known = held.join(labels, "id", "left").select("run", "hub", "id", "n", F.coalesce("label", "id").alias("label"))
    apart = known.groupBy("run").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("run")
    group = scratch.save(known.join(apart, "run", "left_semi").select("hub", "id", "n", "label").distinct(), "apart")
    sizes = group.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("n") / TILE_SHINGLES)).alias("tiles"))
    placed = group.join(sizes, "hub").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = placed.select("hub", "id", "n", "label", "tile", other.alias("other"))
    dealt = dealt.select("hub", "id", "label", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile")
    late = scratch.save(tile_products(dealt.join(texts, "id"), k, share), "late")
    if late.limit(1).count():
        labels = connected_components(links.unionByName(late), scratch)
    scratch.drop(texts)
    named = rows.join(labels, "id", "left").select("id", "doc_id", F.coalesce("label", "id").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = named.join(least, "label").select("id", "component_id")
    return sets.join(component, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
