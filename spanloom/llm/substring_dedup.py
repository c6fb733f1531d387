"""Substring dedup (8) by recompression.

Every word sequence is rewritten in rounds. A round names maximal runs of one
word and then adjacent pairs whose left symbol falls on side 0 and whose right
symbol on side 1; a symbol's name and side are hashes of its content, so equal
substrings get equal names in every document without any exchange. Only the
symbols at the two ends of a repeat depend on what stands around it.

1. All documents send their second-round symbols to blocks dealt by name; a
   block replies to the documents which of their symbols no other document shares
   (most are shared, so this is the shorter list).
2. Documents send the fingerprints of those windows of ``size`` words all of whose
   own symbols are shared, by names of 80 bits; a block replies which of them also start
   in a document with a smaller id. This verifies the repeat.
3. Documents drop the covered words.

A symbol is a window's own if the window alone decides it. The first and the
last run of a window may go on outside it; first-round symbols made of the runs
between are its own, because a run's side depends on its word alone. Among the
second-round symbols made of those, only the first and the last can hang on a
neighbour outside. So the symbols inside the inner runs, without the first and
the last, occur in every document that has the window, and no repeat escapes
step 1. A window without such symbols goes to step 2 anyway.

Positions travel packed by (block, batch of documents), so a row of the shuffle
holds thousands of them; a document's replies are at most its own length.

Null, empty and blank texts have no words. Rows with a null id take part in
nothing and keep all words. Rows that repeat a ``doc_id`` are one document with
several texts: each row loses what stands under a smaller id, and equal rows are
treated alike. Columns other than id and text are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Words, from_planes, grams, mix, pieces, planes
from .scratch import Scratch, parallelism


def _first_of_doc(first: np.ndarray, n: int) -> np.ndarray:
    """Flags the positions 0..n-1 at which a document begins."""
    flags = np.zeros(n + 1, dtype=bool)
    flags[first] = True
    return flags[:n]


def compress_pairs(names: np.ndarray, begins: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: new names, and which old symbols begin a new one. Pairs never cross documents."""
    side = (mix(names ^ U(salt)) & U(1)).astype(bool)
    joined = np.zeros(len(names), dtype=bool)  # merges with the symbol before it
    joined[1:] = side[1:] & ~side[:-1] & ~begins[1:]
    left = np.zeros(len(names), dtype=bool)
    left[:-1] = joined[1:]
    out = names.copy()
    at = np.flatnonzero(left)
    out[at] = mix(names[at] * U(0x9FB21C651E98DF25) + mix(names[at + 1]) + U(salt))
    return out[~joined], ~joined


def parse(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Second-round symbols: name and first word; and the flags of words that begin a run."""
    n = len(words.hash)
    doc = _first_of_doc(words.first, n)
    run = doc.copy()
    run[1:] |= words.hash[1:] != words.hash[:-1]
    run[:1] = True
    at = np.flatnonzero(run)
    length = np.diff(np.append(at, n)).astype(U)
    side_by_word = words.hash[at]
    side = (mix(side_by_word ^ U(0x51)) & U(1)).astype(bool)  # by the word alone: a cut run keeps its side
    names = mix(side_by_word + mix(length))
    joined = np.zeros(len(at), dtype=bool)
    joined[1:] = side[1:] & ~side[:-1] & ~doc[at[1:]]
    left = np.zeros(len(at), dtype=bool)
    left[:-1] = joined[1:]
    pair = np.flatnonzero(left)
    names[pair] = mix(names[pair] * U(0x9FB21C651E98DF25) + mix(names[pair + 1]))
    at, names = at[~joined], names[~joined]
    names, begins = compress_pairs(names, doc[at], 0x52)
    at = at[begins]
    return names, at, run


#: Entries of one key in one flush that make it frequent there.
FREQUENT = 32


class Packer:
    """Collects (key, row, position) and packs them into rows by block.

    A key that is frequent in a flush and stands in several of its documents answers
    itself. For ``shared`` the block gets one entry of its smallest id and one of its
    greatest; else the entries of the smallest id, and the others travel as told, dealt
    at random. So a key that stands in every document costs a block a bounded number of
    entries a flush.
    """

    def __init__(self, blocks: int, shared: bool, most: int = 1 << 19):
        self.blocks, self.shared, self.most = blocks, shared, most
        self.held: list[tuple] = []
        self.rows: list[tuple] = []
        self.size = self.flushes = self.n_rows = 0

    def add(self, keys: tuple[np.ndarray, ...], ids: np.ndarray, tags: np.ndarray, rows: np.ndarray, positions: np.ndarray) -> None:
        """``keys`` are one or two arrays of names; ``rows`` index ``ids`` and ``tags``."""
        if len(keys[0]):
            self.held.append((keys[0], keys[-1], rows + self.n_rows, positions.astype(np.uint32)))
            self.rows.append((ids, tags))
            self.n_rows += len(ids)
            self.size += len(keys[0])

    def full(self) -> bool:
        return self.size > self.most

    def flush(self) -> pa.RecordBatch:
        keys, more, row, positions = (np.concatenate([h[j] for h in self.held]) for j in range(4))
        ids, tags = (np.concatenate([r[j] for r in self.rows]) for j in (0, 1))
        self.held, self.rows, self.size, self.n_rows, self.flushes = [], [], 0, 0, self.flushes + 1
        at = _by_name(keys, more)
        keys, more, row, positions = keys[at], more[at], row[at], positions[at]
        docs = ids[row]
        first, length = _groups(keys, more)
        least, greatest = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
        several = np.repeat((least != greatest) & (length > FREQUENT), length)
        if self.shared:
            told = np.zeros(len(keys), dtype=bool)
            ask = ~several
            for ends in (least, greatest):  # one entry of either end
                which = np.flatnonzero(several & (docs == np.repeat(ends, length)))
                group = np.repeat(np.arange(len(first)), length)[which]
                ask[which[np.concatenate([[True], group[1:] != group[:-1]])[: len(which)]]] = True
        else:
            told = several & (docs > np.repeat(least, length))
            ask = ~told
        block = ((keys >> U(40)) % U(self.blocks)).astype(np.int64)
        rows: list[tuple] = []

        def put(b: int, which: np.ndarray) -> None:
            mine, place = np.unique(row[which], return_inverse=True)
            names = planes(keys[which] if not self.shared else keys[which].astype(np.uint32)), planes((more[which] >> U(48)).astype(np.uint16)) if not self.shared else None
            rows.append((b, *names, planes(ids[mine]), planes(tags[mine]), planes(place.astype(np.uint32)), planes(positions[which])))

        which = np.flatnonzero(ask)
        which = which[np.argsort(block[which], kind="stable")]
        ends = np.cumsum(np.bincount(block[which], minlength=self.blocks)).tolist()
        for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if hi > lo:
                put(b, which[lo:hi])
        if told.any():
            put(self.blocks + (TaskContext.get().partitionId() * 1009 + self.flushes) % (1 << 20), np.flatnonzero(told))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 7)], PACKED.split(", "))


PACKED = "block, keys, more, ids, tags, which, positions"
PACKED_SCHEMA = "block int, keys binary, more binary, ids binary, tags binary, which binary, positions binary"


def _by_name(keys: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The order by both names."""
    at = np.argsort(keys)
    if more is not keys and np.any((keys[at[1:]] == keys[at[:-1]]) & (more[at[1:]] != more[at[:-1]])):
        return np.lexsort((more, keys))
    return at


def _groups(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal names begins, and its length."""
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])])[: len(keys)])
    return first, np.diff(np.append(first, len(keys)))


def reply(packed: DataFrame, blocks: int, shared: bool) -> DataFrame:
    """``(doc_id, tag, hits)`` per row name: positions whose key no other document has (shared) or a smaller id has."""
    kind = np.uint32 if shared else np.uint64

    def block(table: pa.Table) -> pa.Table:
        keys, more, docs, tags, positions = [], [], [], [], []
        for k, m, i, t, w, p in zip(*(table.column(c) for c in ("keys", "more", "ids", "tags", "which", "positions")), strict=True):
            row = from_planes(w.as_py(), np.uint32)
            keys.append(from_planes(k.as_py(), kind))
            more.append(keys[-1] if shared else from_planes(m.as_py(), np.uint16))
            docs.append(from_planes(i.as_py(), np.int64)[row])
            tags.append(from_planes(t.as_py(), np.int64)[row])
            positions.append(from_planes(p.as_py(), np.uint32))
        keys, more, docs, tags, positions = (np.concatenate(x) for x in (keys, more, docs, tags, positions))
        if table.column("block")[0].as_py() < blocks:
            at = _by_name(keys, more)
            keys, more, docs, tags, positions = keys[at], more[at], docs[at], tags[at], positions[at]
            first, length = _groups(keys, more)
            least = np.minimum.reduceat(docs, first)
            told = np.repeat(least == np.maximum.reduceat(docs, first), length) if shared else docs > np.repeat(least, length)
            docs, tags, positions = docs[told], tags[told], positions[told]
        at = np.lexsort((positions, tags, docs))
        docs, tags, positions = docs[at], tags[at], positions[at]
        first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])[: len(docs)])
        ends = np.append(first[1:], len(docs)).tolist()[: len(first)]
        hits = [positions[lo:hi].tobytes() for lo, hi in zip(first.tolist(), ends, strict=True)]
        return pa.table({"doc_id": pa.array(docs[first], pa.int64()), "tag": pa.array(tags[first], pa.int64()), "hits": pa.array(hits, pa.binary())})

    rows = packed.groupBy("block").applyInArrow(lambda t: block(t), "doc_id long, tag long, hits binary")
    return rows.groupBy("doc_id", "tag").agg(F.collect_list("hits").alias("hits"))


def _hits(column: pa.Array, words: Words) -> np.ndarray:
    """Positions in the batch's word sequence from the replies to each document."""
    out = []
    for i, blobs in enumerate(column.to_pylist()):
        if blobs:
            at = np.frombuffer(b"".join(blobs), dtype=np.uint32).astype(np.int64)
            out.append(words.first[i] + at[at < words.first[i + 1] - words.first[i]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _rows(words: Words, piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and tags of a piece's rows, and the row of each word."""
    ids, tags = (piece.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 2))
    return ids, tags, np.repeat(np.arange(len(words)), np.diff(words.first))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row; kept has the words left, joined by one space."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tag"))
    scratch = Scratch(spark, "substrings")
    bytes_in = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = max(32, parallelism(spark), min(-(-bytes_in // block_bytes), 1 << 20))

    def symbols(batches):
        pack = Packer(blocks, True)
        for batch in batches:
            for piece in pieces(batch.filter(batch.column(0).is_valid()), "text"):
                words = Words(piece.column(1))
                if len(words.hash):
                    names, at, _ = parse(words)
                    ids, tags, row = _rows(words, piece)
                    pack.add((names,), ids, tags, row[at], at - words.first[row[at]])
                if pack.full():
                    yield pack.flush()
        if pack.size:
            yield pack.flush()

    def windows(batches):
        pack = Packer(blocks, False)
        for batch in batches:
            for piece in pieces(batch.filter(batch.column(0).is_valid()), "text"):
                words = Words(piece.column(1))
                n = len(words.hash)
                if n < size:
                    continue
                _, at, run = parse(words)
                shared = np.ones(n, dtype=bool)
                shared[_hits(piece.column(3), words)] = False
                strange = np.concatenate([[0], np.cumsum(~shared[at])])
                starts = np.zeros(n + 1, dtype=bool)
                starts[at] = True
                before = np.concatenate([[0], np.cumsum(starts[:n])])  # symbols that begin before a word
                starts[n] = True
                runs = np.cumsum(run) - 1
                begin = np.append(np.flatnonzero(run), n)
                room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n) >= size
                i = np.flatnonzero(room)
                lo, hi = begin[runs[i] + 1], begin[runs[i + size - 1]]  # without the first and the last run
                first, last = before[lo], before[hi] - ~starts[hi]  # symbols wholly inside
                out = i[(last - first <= 2) | (strange[np.maximum(last - 1, 0)] <= strange[np.minimum(first + 1, len(at))])]
                ids, tags, row = _rows(words, piece)
                names = grams(words.hash, size)[out], grams(mix(words.hash ^ U(0xE7037ED1A0B428DB)), size)[out]
                pack.add(names, ids, tags, row[out], out - words.first[row[out]])
                if pack.full():
                    yield pack.flush()
        if pack.size:
            yield pack.flush()

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                words = Words(piece.column(1))
                n = len(words.hash)
                change = np.zeros(n + size + 1, dtype=np.int64)
                hits = _hits(piece.column(3), words)
                np.add.at(change, hits, 1)
                np.add.at(change, hits + size, -1)
                keep = np.cumsum(change[:n]) <= 0
                kept, removed = [], []
                for i in range(len(words)):
                    lo, hi = int(words.first[i]), int(words.first[i + 1])
                    mine = words.data[words.doc_bytes[i] : words.doc_bytes[i + 1]].tobytes().split()
                    gone = hi - lo - int(np.count_nonzero(keep[lo:hi]))
                    kept.append(b" ".join(compress(mine, keep[lo:hi].tolist()) if gone else mine))
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    told = lambda hits: docs.join(hits, ["doc_id", "tag"], "left").select("doc_id", "text", "tag", "hits")
    first = scratch.save(reply(docs.mapInArrow(symbols, PACKED_SCHEMA), blocks, True), "shared")
    second = scratch.save(reply(told(first).mapInArrow(windows, PACKED_SCHEMA), blocks, False), "repeats")
    scratch.drop(first)
    return told(second).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
