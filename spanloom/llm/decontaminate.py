"""Benchmark decontamination (1) by spaced-seed hashing.

Tokens are lower-cased words without surrounding ASCII punctuation. A window of
``SPAN`` tokens is cut into six blocks of two; each of twenty masks hashes three
blocks and ignores the others, so any three substituted tokens leave one mask
untouched. With one more mask every stretch of 12 or more tokens of which 75 %
are equal is hit (a search over all seed-avoiding patterns finds none), so for
the default ``least`` and ``share`` no overlap is missed. Items shorter than a
window use windows of their own length, cut into two blocks more than they may
have substitutions, and masks of two blocks.

Hashes of the items are joined with hashes of all windows of all documents. The
items are sent to the executors in blocks of bounded size (``block_tokens``
tokens, whatever the benchmark's size); for each block every document is read
once. Around each hit the item is laid over the document on the hit's diagonal
and the aligned tokens are compared; any stretch of at least ``least`` tokens (or
the whole item if it is shorter) with ``share`` percent of them equal is a match.
The best stretch, scored +1 for an equal and -2 for a different token, is
reported if it is one, else the first longest that is.

Null, empty or blank texts and items have no tokens and match nothing; items
under ``shortest`` tokens are no evidence and match nothing. Repeated rows each
get their own matches, of documents and of items; a row and an item that overlap in
several places give one match, with the most equal tokens, then the first. Columns
other than ids and texts are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import U, Words, mix, pieces

SPAN = 12


def block_masks(size: int, blocks: int, kept: int) -> list[np.ndarray]:
    """The token positions of each choice of ``kept`` of ``blocks`` blocks of a window."""
    cut = np.array_split(np.arange(size), blocks)
    return [np.concatenate(c) for c in combinations(cut, kept)]


#: The token positions each mask keeps; the last is for stretches whose windows all have four substitutions.
MASKS = [*block_masks(SPAN, 6, 3), np.array([0, 2, 3, 5, 7, 9])]
_FACTOR = mix(np.arange(1, SPAN + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)) | U(1)
_FILTER_BITS = 22
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[list(PUNCTUATION)] = True


class Tokens(Words):
    """Lower-cased words whose ASCII punctuation does not count: ``hash`` is of the rest; pure punctuation is one token."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("") if texts.null_count else texts
        texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
        buffers = texts.buffers()
        super().__init__(texts, lower=True)
        if len(self.data) and buffers[2] is not None:
            kept = np.where(_PUNCTUATION[self.data], np.uint8(0), self.data)
            # The sum over a word's other bytes, placed by their rank among them.
            from .hashing import _BYTE, _power_tables

            solid = kept != 0
            rank = np.cumsum(solid) - solid
            power, inverse = _power_tables(len(kept) + 1)
            sums = np.zeros(len(kept) + 1, dtype=U)
            np.cumsum(np.where(solid, _BYTE[kept] * power[rank], U(0)), out=sums[1:])
            rank = np.append(rank, rank[-1] + solid[-1])
            self.hash = mix((sums[self.end] - sums[self.start]) * inverse[rank[self.start]] + U(1))


def masked(hashes: np.ndarray, mask: np.ndarray, salt: int, size: int | None = None) -> np.ndarray:
    """Hashes of all windows of ``size`` tokens (as far as the mask reaches if None) under one mask."""
    n = len(hashes) - (size or int(mask[-1]) + 1) + 1
    out = np.zeros(max(n, 0), dtype=U)
    for i in mask if n > 0 else ():
        out += hashes[i : n + i] * _FACTOR[i]
    return mix(out + U(salt))


def short_masked(hashes: np.ndarray, size: int, share: int) -> list[np.ndarray]:
    """Hashes of all windows of ``size`` < SPAN tokens under masks that spare all substitutions ``share`` allows."""
    wrong = min(size - 1, size * (100 - share) // 100)
    blocks = min(size, wrong + 2)
    return [masked(hashes, m, 1000 * size + s, size) for s, m in enumerate(block_masks(size, blocks, blocks - wrong))]


class Probe:
    """The hashes of one block of items, sorted, with a bit filter in front."""

    def __init__(self, ids: list[int], tokens: list[np.ndarray], shortest: int, share: int):
        self.ids, self.tokens = ids, tokens
        keys, items, at = [], [], []
        self.sizes = sorted({len(t) for t in tokens if shortest <= len(t) < SPAN})
        for k, t in enumerate(tokens):
            found = []
            if len(t) >= SPAN:
                found = [masked(t, m, s) for s, m in enumerate(MASKS)]
            elif len(t) >= shortest:
                found = short_masked(t, len(t), share)
            for h in found:
                keys.append(h)
                items.append(np.full(len(h), k, dtype=np.int32))
                at.append(np.arange(len(h), dtype=np.int32))
        keys = np.concatenate(keys) if keys else np.zeros(0, dtype=U)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.items = np.concatenate(items)[order] if items else np.zeros(0, dtype=np.int32)
        self.at = np.concatenate(at)[order] if at else np.zeros(0, dtype=np.int32)
        self.shift = U(64 - max(_FILTER_BITS, min(26, len(self.keys).bit_length() + 2)))
        self.filter = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.filter[(self.keys >> self.shift).astype(np.int64)] = True

    def diagonals(self, hashes: np.ndarray, first: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
        """Columns (document, item, shift) of the equal pairs of hashes, at most ``most`` pairs (or those of one window) at a time."""
        where = np.flatnonzero(self.filter[(hashes >> self.shift).astype(np.int64)])
        lo = np.searchsorted(self.keys, hashes[where], "left")
        count = np.searchsorted(self.keys, hashes[where], "right") - lo
        where, lo, count = where[count > 0], lo[count > 0], count[count > 0]
        total, at = np.cumsum(count), 0
        while at < len(where):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            c = count[at:end]
            inside = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            pick = np.repeat(lo[at:end], c) + inside
            start = np.repeat(where[at:end], c)
            doc = np.searchsorted(first, start, side="right") - 1
            yield np.unique(np.stack([doc, self.items[pick], start - self.at[pick]]), axis=1)
            at = end


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """The first stretch [lo, hi) with the greatest score, +1 for an equal and -2 for a different token."""
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    floor = np.minimum.accumulate(score)
    hi = int(np.argmax(score - floor))
    return int(np.argmax(score[: hi + 1] == floor[hi])), hi


def passing_stretch(same: np.ndarray, least: int, share: int) -> tuple[int, int] | None:
    """The best stretch if it has ``least`` tokens and ``share`` percent of them equal, else the first longest that has, else None."""
    a, b = best_stretch(same)
    if b - a >= least and 100 * int(np.count_nonzero(same[a:b])) >= share * (b - a):
        return a, b
    rest = np.concatenate([[0], np.cumsum(np.where(same, 100 - share, -share))])
    # The greatest sum at or after each end never rises with the end, so the last end that suffices is found by bisection.
    ahead = np.maximum.accumulate(rest[::-1])
    hi = len(same) - np.searchsorted(ahead, rest, "left")
    width = hi - np.arange(len(rest))
    lo = int(np.argmax(width))
    return (lo, lo + int(width[lo])) if width[lo] >= max(1, least) else None


def scan(docs: DataFrame, probe, least: int, share: int) -> DataFrame:
    """Verified matches of one block of items."""

    def run(batches):
        p = probe.value
        for batch in batches:
            out = []
            for piece in pieces(batch, "text"):
                tokens = Tokens(piece.column(1))
                if not len(tokens.hash):
                    continue
                windows = chain(((m, None) for m in enumerate(MASKS)), ((None, n) for n in p.sizes))
                held, size = [np.zeros((3, 0), dtype=np.int64)], 0
                for m, n in windows:
                    for h in [masked(tokens.hash, m[1], m[0])] if m else short_masked(tokens.hash, n, share):
                        for part in p.diagonals(h, tokens.first):
                            held.append(part)
                            size += part.shape[1]
                            if size > 1 << 21:
                                held, size = [np.unique(np.concatenate(held, axis=1), axis=1)], 0
                if len(held) == 1 and not held[0].size:
                    continue
                diagonal = np.unique(np.concatenate(held, axis=1), axis=1)
                best: dict[tuple[int, int], tuple] = {}
                ids = piece.column(0).to_pylist()
                for d, k, shift in diagonal.T.tolist():
                    t, first, end = p.tokens[k], int(tokens.first[d]), int(tokens.first[d + 1])
                    lo, hi = max(0, first - shift), min(len(t), end - shift)
                    if hi <= lo:
                        continue
                    same = t[lo:hi] == tokens.hash[shift + lo : shift + hi]
                    if found := passing_stretch(same, min(least, len(t)), share):
                        a, b = found
                        equal = int(np.count_nonzero(same[a:b]))
                        row = (equal, first - shift - lo - a, -lo - a, b - a)
                        best[d, k] = max(best.get((d, k), row), row)
                out += [(ids[d], p.ids[k], len(p.tokens[k]), equal, size, -start, -at) for (d, k), (equal, start, at, size) in best.items()]
            names = ["doc_id", "item_id", "item_words", "n_equal", "n_aligned", "doc_start", "item_start"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(7)], names)

    return docs.mapInArrow(run, "doc_id long, item_id long, item_words long, n_equal long, n_aligned long, doc_start long, item_start long")


def item_blocks(benchmark: DataFrame, block_tokens: int, shortest: int, share: int):
    """The items as probes of at most ``block_tokens`` tokens (or one item) each."""
    ids, tokens, held = [], [], 0
    for row in benchmark.toLocalIterator():
        t = Tokens(pa.array([row["text"]], pa.string())).hash
        if held and held + len(t) > block_tokens:
            yield Probe(ids, tokens, shortest, share)
            ids, tokens, held = [], [], 0
        ids.append(row["item_id"])
        tokens.append(t)
        held += len(t)
    if ids:
        yield Probe(ids, tokens, shortest, share)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 12, share: int = 75, shortest: int = 5, block_tokens: int = 1 << 19) -> DataFrame:
    """``(doc_id, item_id, item_words, n_equal, n_aligned, doc_start, item_start)``, one row per row of ``docs`` and item that overlap."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null").orderBy("item_id", "text")
    found = None
    for probe in item_blocks(items, block_tokens, shortest, share):
        part = scan(docs, spark.sparkContext.broadcast(probe), least, share)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, item_words long, n_equal long, n_aligned long, doc_start long, item_start long")
    return found
