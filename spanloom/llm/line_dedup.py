"""Line dedup (6): an exact set-similarity join of lines.

A line is removed if an earlier line of the corpus (by document id, then line
number) has a word set with Jaccard similarity of at least ``share`` percent;
``removed`` earlier lines count as evidence too. Lines of equal sets are settled
first, by two 64-bit fingerprints; the first of each meet in the join:

* the words of a line are ordered by rarity, counted over the whole corpus in
  ``1 << CELL_BITS`` hashed cells;
* prefix filter on keys of k neighbours in that order: of sets of n and m words with x
  and y words of their own, at most ``k x + (k - 1) y <= k n (1 - t)`` keys of the first
  are not keys of the second. So in any global order of keys the first l that both have
  are among the first ``k n (1 - t) + l`` of each; l is ``1 + n / 16``. Keys have three words, for sets of less
  than ``LONG`` words and sets similar to such ones two. Three rare words side by side
  hardly meet by chance, so candidates grow with the copies, not with the square of the
  corpus. The order puts keys behind all others whose cell, counted over the corpus, is
  crowded, then goes by rarity; only these prefixes are written;
* length filter ``t max(n, m) <= min(n, m)`` and positional filter on the words
  that can still be equal before and after the shared ones;
* the Jaccard similarity of the surviving pairs is verified on the words.

Lines that share l keys, each with few others, are held against each of them, lines
of a larger group against the earliest (its hub). What that leaves is
held against all earlier members of its hubs in tiles inside tasks, which emit the
similar lines and never pairs. A key that is frequent in one flush of a task sends
its earliest line alone to the key's block; the other lines travel
beside, dealt at random, and find their hub by a join that may be split.

The entries of the prefixes travel packed in rows by block (DataFrame rows of the
same entries took more disk and time than the input allows); texts are shuffled
by id for the entries, for the lines to verify and for the result. Lines are the parts between newlines; words are runs outside space
and 0x09-0x0D. Lines without a word are kept. A null text stays null; an empty one
stays empty. ``doc_id`` names a document: rows that repeat an id must repeat the
text, and get the same text. Rows with a null id are kept as they are. Other
columns pass through, but for ``n_lines`` and ``n_removed``, which are new.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cells import cell_of, counted, summed, table_row
from .hashing import U, Words, from_planes, mix, pieces, planes
from .quality import BLANKS, words_of
from .scratch import Scratch, parallelism

CELL_BITS = 18
#: Sizes and positions in a line from here on are not told apart by the filters.
FULL = (1 << 15) - 1
#: Groups up to here are compared pair by pair, larger ones with their hub.
SMALL = 12
#: Entries of one key in one flush that make it frequent there.
FREQUENT = 32
#: Rows and words of a tile, as expected numbers.
TILE_LATER, TILE_EARLIER, TILE_WORDS = 400, 2000, 1 << 20
#: Sets of so many words have keys of three words.
LONG = 12
#: For each so many words, two sets must share one key more.
SPARE = 16


def _solid(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def _by_line(line: np.ndarray, rank: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The order by line, then rank (10 bits), then name."""
    if not len(line) or int(line[-1]) >> 20:
        return np.lexsort((name, (line << 10) | rank))
    key = (((line << 10) | rank).astype(U) << U(34)) | (name >> U(30))  # one number sorts much faster
    at = np.argsort(key)
    words, key, name = name, key[at], name[at]
    if np.any((key[1:] == key[:-1]) & (name[1:] != name[:-1])):  # two words alike in 34 bits
        return np.lexsort((words, (line << 10) | rank))
    return at


class LineSets:
    """The word sets of all lines with words: ``row`` and ``number`` of each line, its size ``n``;
    and for each distinct word its ``name``, its ``line`` and its ``place`` in the line, rarest first."""

    def __init__(self, texts: pa.Array, rarity: np.ndarray):
        words = Words(texts)
        breaks = np.flatnonzero(words.data == 10)
        row = np.repeat(np.arange(len(words)), np.diff(words.first))
        number = np.searchsorted(breaks, words.start) - np.searchsorted(breaks, words.doc_bytes[:-1])[row]
        begins = np.ones(len(row), dtype=bool)
        begins[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        self.row, self.number = row[begins], number[begins]
        line = np.cumsum(begins) - 1
        rank = rarity[cell_of(words.hash, CELL_BITS)]
        at = _by_line(line, rank, words.hash)
        name, line = words.hash[at], line[at]
        fresh = np.ones(len(name), dtype=bool)
        fresh[1:] = (name[1:] != name[:-1]) | (line[1:] != line[:-1])
        self.name, self.line = name[fresh], line[fresh]
        self.n = np.bincount(self.line, minlength=len(self.row))
        self.first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(self.name)) - self.first[self.line]

    def keys(self, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of all lines, line by line: each one's name, its words (2 or 3), and its first word as an index.

        A set of one word has a key of that word and nothing.
        """
        n = self.n[self.line]
        after = np.zeros(len(self.name) + 2, dtype=U)
        after[: len(self.name)] = mix(self.name)
        two = np.flatnonzero(((self.place < n - 1) | (n == 1)) & (share * n < 100 * LONG))
        three = np.flatnonzero((self.place < n - 2) & (n >= LONG))
        single = n[two] == 1
        names = [mix(self.name[two] + np.where(single, U(0), after[two + 1])), mix(mix(self.name[three] + after[three + 1]) + after[three + 2] + U(3))]
        return np.concatenate(names), np.repeat([2, 3], [len(two), len(three)]), np.concatenate([two, three])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit fingerprints of each line's word set."""
        if not len(self.first):
            return self.name[:0], self.name[:0]
        size = self.n.astype(U)
        return mix(np.add.reduceat(mix(self.name), self.first) + size), mix(np.add.reduceat(mix(self.name ^ U(0xA0761D6478BD642F)), self.first) + size)


class Seen:
    """The earliest place of each word set in a task so far, so that later ones need not be told again."""

    def __init__(self, most: int = 1 << 20):
        self.at: dict[tuple[int, int], tuple[int, int]] = {}
        self.most = most

    def new(self, sets: LineSets, ids: np.ndarray) -> np.ndarray:
        """Flags the lines whose set has not stood in an earlier line of the task."""
        if len(self.at) > self.most:
            self.at.clear()
        out = np.zeros(len(ids), dtype=bool)
        names = zip(*(x.tolist() for x in sets.names()), strict=True)
        for j, (name, where) in enumerate(zip(names, zip(ids.tolist(), sets.number.tolist(), strict=True), strict=True)):
            if (before := self.at.get(name)) is None or where < before:
                self.at[name] = where
                out[j] = True
        return out


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Cells in 16 steps a doubling, 10 bits: rare words come first."""
    return np.minimum(1023, np.floor(16 * np.log2(np.maximum(counts, 1)))).astype(np.int64)


def crowded_ranks(counts: np.ndarray) -> np.ndarray:
    """0 for cells with up to four times the usual count, more by the logarithm beyond."""
    usual = 4 * counts.mean() + 4
    return np.where(counts > usual, 1 + np.minimum(254, np.floor(8 * np.log2(np.maximum(counts, 1) / usual))), 0).astype(np.uint8)


def prefix_length(n: np.ndarray, k: np.ndarray, share: int) -> np.ndarray:
    """How many keys of k words of a set of n words its prefix has."""
    return np.maximum(1, np.minimum(n - k + 1, k * (100 - share) * n // 100 + 1 + n // SPARE))


def possible(n, p, o, q, share: int):
    """The length and positional filters: sets of n and o words with a shared key at places p and q."""
    need = -(-share * (n + o) // (100 + share))
    ok = (share * np.maximum(n, o) <= 100 * np.minimum(n, o)) & (np.minimum(p, q) + np.minimum(n - p, o - q) >= need)
    return ok | (np.maximum(n, o) >= FULL)


def _chosen(own: pa.Array, sets: LineSets) -> np.ndarray:
    """Flags the lines whose number their row's ``own`` lists."""
    own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
    row = np.repeat(np.arange(len(own)), np.asarray(own.value_lengths().fill_null(0)))
    return np.isin((sets.row << 32) | sets.number, (row << 32) | own.flatten().to_numpy(zero_copy_only=False))


def _ids(piece: pa.RecordBatch, sets: LineSets) -> np.ndarray:
    return piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[sets.row]


def profile(docs: DataFrame, rarity: np.ndarray, share: int) -> DataFrame:
    """Rows ``(k, l, x, xi)`` with the fingerprints of the lines' word sets, and rows ``(task, blob)`` with a task's counts of keys."""
    columns = ["k", "l", "x", "xi"]

    def run(batches):
        seen, total = Seen(), np.zeros(1 << CELL_BITS, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 19):
                sets = LineSets(piece.column(1), tables.value)
                ids = _ids(piece, sets)
                total += np.bincount(cell_of(sets.keys(share)[0], CELL_BITS), minlength=1 << CELL_BITS)
                new = seen.new(sets, ids)
                m = int(new.sum())
                names = [pa.array(x[new].view(np.int64)) for x in sets.names()] + [pa.array(ids[new]), pa.array(sets.number[new], pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], [*columns, "task", "blob"])
        table = table_row(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 4 + list(table.columns), [*columns, "task", "blob"])

    tables = docs.sparkSession.sparkContext.broadcast(rarity)
    return docs.select("doc_id", "text").mapInArrow(run, "k long, l long, x long, xi long, task long, blob binary")


def entries(docs: DataFrame, rarity: np.ndarray, crowded: np.ndarray, blocks: int, share: int) -> DataFrame:
    """Rows ``(block, key, doc, number, size, place)``: the prefix entries of the lines ``own`` of ``docs(doc_id, text, own)``, packed by block of their key.

    A size's upper bit tells that other lines of the key travel in a row from block ``blocks`` on.
    """
    columns = ["key", "doc", "number", "size", "place"]

    def run(batches):
        rarity_, crowded_ = tables.value
        held, size, flushes = [], 0, 0

        def flush():
            key, doc, number, n, p = (np.concatenate([h[j] for h in held]) for j in range(5))
            key = (((key >> U(40)) % U(blocks)) << U(40)) | (key & U((1 << 40) - 1))
            at = np.argsort(key)
            key, doc, number, n, p = key[at], doc[at], number[at], np.minimum(n[at], FULL).astype(np.uint16), np.minimum(p[at], FULL).astype(np.uint16)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            length = np.diff(np.append(begin, len(key)))
            aside = np.zeros(len(key), dtype=bool)
            for b, c in zip(begin[length > FREQUENT].tolist(), length[length > FREQUENT].tolist(), strict=True):
                first = b + int(np.lexsort((number[b : b + c], doc[b : b + c]))[0])
                aside[b : b + c] = True
                aside[first] = False
                n[first] |= 1 << 15
            block = (key >> U(40)).astype(np.int64)
            rows = []
            parts = [(x[aside], blocks + (TaskContext.get().partitionId() * 1009 + flushes) % (1 << 20)) for x in (np.arange(len(key)),)]
            main = np.flatnonzero(~aside)
            ends = np.cumsum(np.bincount(block[main], minlength=blocks)).tolist()
            parts += [(main[lo:hi], b) for b, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True))]
            for which, b in parts:
                if len(which):
                    rows.append((b, *(planes(x[which]) for x in (key, doc, number, n, p))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[j] for r in rows], pa.binary()) for j in range(1, 6)], ["block", *columns])

        for batch in batches:
            for piece in pieces(batch, "text", 1 << 19):
                sets = LineSets(piece.column(1), rarity_)
                ids = _ids(piece, sets)
                mine = _chosen(piece.column(2), sets)
                name, k, at = sets.keys(share)
                line = sets.line[at]
                new = mine[line]
                name, k, at, line = name[new], k[new], at[new], line[new]
                group = 2 * line + (k == 3)
                order = np.argsort((group << 8) | crowded_[cell_of(name, CELL_BITS)], kind="stable")
                name, k, at, line, group = name[order], k[order], at[order], line[order], group[order]
                count = np.bincount(group, minlength=1)
                keep = np.arange(len(group)) - (np.cumsum(count) - count)[group] < prefix_length(sets.n[line], k, share)
                at, line = at[keep], line[keep]
                held.append((name[keep], ids[line], sets.number[line].astype(np.uint32), sets.n[line], sets.place[at]))
                size += len(at)
                if size > 1 << 19:
                    yield flush()
                    held, size, flushes = [], 0, flushes + 1
        if size:
            yield flush()

    tables = docs.sparkSession.sparkContext.broadcast((rarity, crowded))
    return docs.select("doc_id", "text", "own").mapInArrow(run, "block int, key binary, doc binary, number binary, size binary, place binary")


#: Kinds of rows that blocks give: pairs of a small group, members of a hub, hubs of frequent keys, their other lines, pairs with a hub.
PAIR, MEMBER, HUB, ASIDE, STAR = range(5)
MET = ["kind", "key", "x", "xi", "y", "yi", "n", "p"]


def meet(packed: DataFrame, blocks: int, share: int) -> DataFrame:
    """What a block finds (columns ``MET``): line ``xi`` of document ``x`` against the earlier line ``yi`` of ``y``."""

    def block(table: pa.Table) -> pa.Table:
        kinds = {"key": U, "doc": np.int64, "number": np.uint32, "size": np.uint16, "place": np.uint16}
        columns = [np.concatenate([from_planes(v.as_py(), k) for v in table.column(c)]) for c, k in kinds.items()]
        out = []

        def tell(kind, key, x, xi, y, yi, n, p):
            out.append([np.full(len(key), kind, dtype=np.int64), key.view(np.int64), x, xi, y, yi, n, p])

        def read(columns):
            key, doc, number, n, p = columns
            return key, doc, number.astype(np.int64), (n & np.uint16(FULL)).astype(np.int64), p.astype(np.int64), n > FULL

        if table.column("block")[0].as_py() >= blocks:
            key, doc, number, n, p, _ = read(columns)
            tell(ASIDE, key, doc, number, doc, number, n, p)
        else:
            key = columns[0]
            at = np.argsort(key)
            same = key[at[1:]] == key[at[:-1]]
            alone = np.ones(len(key), dtype=bool)
            alone[1:] &= ~same
            alone[:-1] &= ~same
            at = at[~alone | (columns[3][at] > FULL)]
            key, doc, number, n, p, frequent = read([c[at] for c in columns])
            at = np.lexsort((number, doc, key))
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (key[at[1:]] != key[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]) | (number[at[1:]] != number[at[:-1]])
            marks, at = np.unique(key[frequent]), at[fresh]
            key, doc, number, n, p = key[at], doc[at], number[at], n[at], p[at]
            frequent = np.isin(key, marks)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            length = np.diff(np.append(begin, len(key)))
            large = np.repeat(length > SMALL, length) | frequent
            first = np.repeat(begin, length)
            place = np.arange(len(key)) - first
            small = [(x, x - d) for d in range(1, SMALL) for x in [np.flatnonzero(~large & (place >= d))]]
            star = [(x := np.flatnonzero(large & (place > 0)), first[x])]
            for kind, pairs in ((PAIR, small), (STAR, star)):
                x, y = (np.concatenate([z[j] for z in pairs]) for j in (0, 1))
                ok = possible(n[x], p[x], n[y], p[y], share)
                x, y = x[ok], y[ok]
                tell(kind, 0 * key[x], doc[x], number[x], doc[y], number[y], np.minimum(n[x], n[y]), p[x])
            x = np.flatnonzero(large)
            tell(MEMBER, 0 * key[x], doc[x], number[x], doc[first[x]], number[first[x]], n[x], p[x])
            x = begin[frequent[begin]]
            tell(HUB, key[x], doc[x], number[x], doc[x], number[x], n[x], p[x])
        return pa.table({c: np.concatenate([o[j] for o in out]).astype(np.int64) for j, c in enumerate(MET)})

    return packed.groupBy("block").applyInArrow(lambda t: block(t), ", ".join(f"{c} long" for c in MET))


def tiles(dealt: DataFrame, share: int) -> DataFrame:
    """``(x, xi)`` of the later lines of each tile ``(y, yi, a, b)`` that have a similar earlier one in it.

    Rows ``(y, yi, a, b, early, late, x, xi, line)``: a tile's words index its earlier lines; each later line adds up its overlaps.
    """

    def solve(rows: list[tuple]):
        sets = [set(r[4].split()) for r in rows]
        earlier = [j for j, r in enumerate(rows) if r[0]]
        where = np.array([rows[j][2:4] for j in earlier], dtype=np.int64).reshape(-1, 2)
        n = np.array([len(sets[j]) for j in earlier], dtype=np.int64)
        lists: dict[bytes, list[int]] = {}
        for k, j in enumerate(earlier):
            for w in sets[j]:
                lists.setdefault(w, []).append(k)
        index = {w: np.array(v) for w, v in lists.items()}
        for (_, late, x, xi, _), mine in zip(rows, sets, strict=True):
            if late:
                hit = [index[w] for w in mine if w in index]
                both = np.bincount(np.concatenate(hit), minlength=len(n)) if hit else np.zeros(len(n), dtype=np.int64)
                before = (where[:, 0] < x) | (where[:, 0] == x) & (where[:, 1] < xi)
                if (before & (100 * both >= share * (len(mine) + n - both)) & (both > 0)).any():
                    yield x, xi

    def run(batches):
        last, rows = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in range(8)] + [batch.column(8).cast(pa.binary()).to_pylist()]
            for y, yi, a, b, early, late, x, xi, line in zip(*columns, strict=True):
                if (y, yi, a, b) != last:
                    found += solve(rows)
                    last, rows = (y, yi, a, b), []
                rows.append((early, late, x, xi, line))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], ["x", "xi"])
        found = list(solve(rows))
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], ["x", "xi"])

    key = ["y", "yi", "a", "b"]
    return dealt.select(*key, "early", "late", "x", "xi", "line").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "x long, xi long").distinct()


def able(members: DataFrame, counts: DataFrame, share: int) -> DataFrame:
    """The ``members(y, yi, x, xi, n, keys)`` of hubs that may share enough keys with some line.

    A line shares with another at most its keys of larger groups and the most keys that small groups show it to share
    with one line (``small`` of ``counts``). A similar line has ``share`` percent of its size at least. So a line that has just a
    few keys in common with a growing crowd is dealt to no tile.
    """
    ends = counts.where("small > 0").select("x", "xi", "small").unionByName(counts.where("small > 0").selectExpr("y as x", "yi as xi", "small"))
    small = ends.groupBy("x", "xi").agg(F.max("small").alias("small"))
    large = members.groupBy("x", "xi").agg(F.sum("keys").alias("large"), F.max("n").alias("size"))
    enough = large.join(small, ["x", "xi"], "left").where(f"large + coalesce(small, 0) > {share} * size div {100 * SPARE}").select("x", "xi")
    return members.join(enough, ["x", "xi"]).select("y", "yi", "x", "xi", "n")


def similar_lines(met: DataFrame, texts: DataFrame, share: int, scratch: Scratch) -> DataFrame:
    """The lines ``(x, xi)`` among the first ones of each set that have an earlier similar line."""
    possible_ = f"greatest(n, o) >= {FULL} or {share} * greatest(n, o) <= 100 * least(n, o) and least(p, q) + least(n - p, o - q) >= ceil({share} * (n + o) / {100 + share})"
    hubs = met.where(f"kind = {HUB}").selectExpr("key", "y", "yi", "n as o", "p as q")
    aside = met.where(f"kind = {ASIDE}").select("key", "x", "xi", "n", "p").join(hubs, "key").where("x <> y or xi <> yi")
    star = met.where(f"kind = {STAR}").select("x", "xi", "y", "yi").unionByName(aside.where(possible_).select("x", "xi", "y", "yi")).withColumn("n", F.lit(0).cast("long")).withColumn("small", F.lit(0))
    pairs = met.where(f"kind = {PAIR}").select("x", "xi", "y", "yi", "n", F.lit(1).alias("small")).unionByName(star)
    # Similar lines that a larger group keeps below their number are members of its hub and meet in the tiles.
    counts = scratch.save(pairs.groupBy("x", "xi", "y", "yi").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.sum("small").alias("small")), "pairs")
    pairs = counts.where(f"c > n div {SPARE}").select("x", "xi", "y", "yi")
    members = met.where(f"kind = {MEMBER}").select("y", "yi", "x", "xi", "n").unionByName(aside.select("y", "yi", "x", "xi", "n"))
    grouped = scratch.save(members.groupBy("y", "yi", "x", "xi").agg(F.max("n").alias("n"), F.count("*").alias("keys")), "grouped")
    scratch.drop(met)
    members = scratch.save(able(grouped, counts, share), "members")
    scratch.drop(grouped)

    # The lines that any of them names are cut out of the texts once.
    ends = [pairs.select("x", "xi", F.lit(True).alias("paired")), pairs.selectExpr("y as x", "yi as xi", "true as paired"), members.selectExpr("x", "xi", "false as paired"), members.selectExpr("y as x", "yi as xi", "false as paired")]
    ends = ends[0].unionByName(ends[1]).unionByName(ends[2]).unionByName(ends[3]).groupBy("x", "xi").agg(F.max("paired").alias("paired"))
    needed = ends.groupBy(F.col("x").alias("doc_id")).agg(F.collect_list(F.struct("xi", "paired")).alias("some"))
    once = texts.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).where("row = 1")
    found = once.join(needed, "doc_id").select("doc_id", "some", F.split("text", "\n").alias("all"))
    named = F.transform("some", lambda e: F.struct(e["xi"].alias("xi"), e["paired"].alias("paired"), F.when(e["xi"] < F.size("all"), F.get("all", e["xi"].cast("int"))).alias("line")))
    found = found.select("doc_id", F.explode(named).alias("l"))
    lines = scratch.save(found.select(F.col("doc_id").alias("x"), "l.xi", "l.paired", "l.line"), "lines")

    sets = lines.where("paired").select("x", "xi", F.array_distinct(words_of(F.col("line"))).alias("a"))
    both = pairs.join(sets, ["x", "xi"]).join(sets.toDF("y", "yi", "b"), ["y", "yi"])
    both = both.select("x", "xi", F.size("a").alias("n"), F.size("b").alias("m"), F.size(F.array_intersect("a", "b")).alias("s"))
    settled = scratch.save(both.where(f"{100 + share} * s >= {share} * (n + m)").select("x", "xi").distinct(), "settled")

    flagged = members.join(settled.withColumn("settled", F.lit(True)), ["x", "xi"], "left")
    flagged = scratch.save(flagged.select("y", "yi", "x", "xi", "n", (F.col("settled").isNull() & ((F.col("x") != F.col("y")) | (F.col("xi") != F.col("yi")))).alias("late")), "late")
    split = lambda rows, which: F.greatest(F.ceil(F.count_if(which) / rows), F.ceil(F.sum(F.when(which, F.col("n"))) / TILE_WORDS))
    sizes = scratch.save(flagged.groupBy("y", "yi").agg(split(TILE_LATER, F.col("late")).alias("as"), split(TILE_EARLIER, F.lit(True)).alias("bs")).where("as > 0"), "sizes")
    # As an earlier line, a member goes to each row of tiles of its column, as a later one to each column of its row; where they cross, once.
    place = lambda k: F.pmod(F.xxhash64("x", "xi"), F.col(k))
    cell = lambda a, b, early, late: F.struct(a.alias("a"), b.alias("b"), early.alias("early"), late.alias("late"))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    down = F.transform(upto("as"), lambda i: cell(i, F.col("mb"), F.lit(True), F.col("late") & (i == F.col("ma"))))
    across = F.transform(F.filter(upto("bs"), lambda j: F.col("late") & (j != F.col("mb"))), lambda j: cell(F.col("ma"), j, F.lit(False), F.lit(True)))
    dealt = flagged.join(sizes, ["y", "yi"]).withColumn("ma", place("as")).withColumn("mb", place("bs"))
    dealt = dealt.select("y", "yi", "x", "xi", F.explode(F.concat(down, across)).alias("c")).select("y", "yi", "c.a", "c.b", "c.early", "c.late", "x", "xi")
    gone = scratch.save(settled.unionByName(tiles(dealt.join(lines.drop("paired"), ["x", "xi"]), share)), "gone")
    for table in (counts, members, lines, settled, flagged, sizes):
        scratch.drop(table)
    return gone


def drop_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 80, block_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with the text's later similar lines removed, plus ``n_lines`` and ``n_removed`` (lines, 0 for a null text)."""
    if share < 75:
        raise ValueError("share must be 75 at least")
    spark = docs.sparkSession
    scratch = Scratch(spark, "line_dedup")
    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*rest).alias("rest")] if rest else []))
    named = packed.where("doc_id is not null")
    texts = named.select("doc_id", "text")

    rarity = rarity_ranks(counted(texts, lambda piece: Words(piece.column(0)).hash, CELL_BITS))
    profiled = scratch.save(profile(texts, rarity, share), "profile")
    crowded = crowded_ranks(summed(profiled.where("blob is not null").select("task", "blob"), CELL_BITS))
    first = profiled.where("blob is null").groupBy("k", "l").agg(F.min(F.struct("x", "xi")).alias("f"))
    first = scratch.save(first.select("f.x", "f.xi"), "first")
    scratch.drop(profiled)
    bytes_in = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = max(32, parallelism(spark), min(-(-bytes_in // block_bytes), 1 << 20))
    own = first.groupBy(F.col("x").alias("doc_id")).agg(F.collect_list("xi").alias("own"))
    met = scratch.save(meet(entries(texts.join(own, "doc_id"), rarity, crowded, blocks, share), blocks, share), "met")
    gone = similar_lines(met, texts, share, scratch)
    stays = first.join(gone, ["x", "xi"], "left_anti").groupBy(F.col("x").alias("doc_id")).agg(F.array_sort(F.collect_list(F.col("xi").cast("int"))).alias("at"))
    gaps = F.transform("at", lambda i, k: F.concat(F.array_repeat(F.lit(False), i - 1 - F.when(k > 0, F.get("at", k - 1)).otherwise(-1)), F.array(F.lit(True))))
    out = named.join(stays.select("doc_id", F.flatten(gaps).alias("stays")), "doc_id", "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~_solid(line) | F.coalesce((i < F.size("stays")) & F.get("stays", i), F.lit(False)))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept"))
    out = out.select("*", kept.alias("kept")).select("doc_id", *(["rest"] if rest else []), F.array_join("kept", "\n").alias("text"), n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"))
    unnamed = packed.where("doc_id is null").select("doc_id", *(["rest"] if rest else []), "text", n.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    out = out.unionByName(unnamed)
    own_names = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text")}
    return out.select(*[own_names.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
