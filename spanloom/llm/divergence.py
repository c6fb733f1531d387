"""Source divergence audit (11): how far the sources of a language use different words, exactly.

A language keeps the V terms that stand in at least ``least_docs`` of its documents. A group is a (language, source) that
occurs; in it a term counted c times has p = 1 + floor(10^9 (c + 5) / (N + 5 V)), N the group's count of kept terms. Groups
are compared by sum |p - q| over the kept terms, and terms of a group with the language by p - q.

Terms with the same sparse vector of counts by source are one *column*: pairs of sources are evaluated once a column and
multiplied by its terms. Zeros are not stored. With p0 for a count of zero, the distance of groups a and b is

    V |p0a - p0b|                                                       all terms as if absent from both
    + sum over terms of a (|pa - p0b| - |p0a - p0b|), and of b likewise from distinct counts of a source
    + sum over terms of both (|pa - pb| - |pa - p0b| - |p0a - pb| + |p0a - p0b|)      from columns

so only sources that share a column meet in it. Terms are ranked as themselves: of a column's terms the first ``top`` in
order can be among a group's first ``top``, and only those are read.

Texts are counted once, in Arrow batches, to rows (lang, source, term, count, documents), which Spark adds up; a source with a
third of all rows is summed where it is read. Groups join by size as Spark chooses. The output has a row for each pair of
a language's sources. Null text, language and source are ''. Repeated rows count as often as they stand, and ids are
not used. A group without terms is a group with N = 0. With V = 0 all pairs have distance 0. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import _LOWER, pieces
from .scratch import Scratch

#: Text bytes that are counted together.
PIECE_BYTES = 8 << 20
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of some texts, one after the other, with the text each stands in."""
    texts = texts.fill_null("").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    inside = _IN_TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[-1]] - at[0]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    kept = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(kept[starts], kept[-1]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(_LOWER[data[inside]])))
    return terms, np.searchsorted(at[1:] - at[0], starts, side="right")


def count_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
    """``(lang, source, term, n, docs)`` of a piece ``(lang, source, text)``; each of its groups has a row with a null term too."""
    terms, row = terms_of(piece.column(2))
    langs, sources = (piece.column(k).dictionary_encode() for k in (0, 1))
    group, codes = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    coded = terms.dictionary_encode()
    term, size = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    in_doc, n = np.unique(row * size + term, return_counts=True)  # a row's distinct terms
    key, place = np.unique(codes[in_doc // size] * size + in_doc % size, return_inverse=True)
    counts, docs = np.bincount(place, weights=n, minlength=len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
    g = np.concatenate([key // size, np.arange(len(group))])
    none = pa.nulls(len(group), pa.large_string())
    named = pa.concat_arrays([coded.dictionary.take(pa.array(key % size)), none]).cast(pa.string())
    zeros = np.zeros(len(group), dtype=np.int64)
    columns = [langs.dictionary.take(pa.array(group[g] // len(sources.dictionary))), sources.dictionary.take(pa.array(group[g] % len(sources.dictionary)))]
    return pa.RecordBatch.from_arrays([*columns, named, pa.array(np.concatenate([counts, zeros])), pa.array(np.concatenate([docs, zeros]))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term in each group, and a null term a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                if piece.num_rows:
                    yield count_piece(piece)

    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)) in decimals, which no count overflows."""
    whole = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", (whole(n) + 5) * F.lit(1_000_000_000).cast("decimal(10,0)"), whole(total) + whole(kept) * 5) + 1


class Audit:
    """The counts, groups and columns of some documents; :meth:`pairs` and :meth:`terms` are the two reports."""

    def __init__(self, docs: DataFrame, least_docs: int = 30, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"):
        scratch = Scratch(docs.sparkSession, "divergence")
        counts = term_counts(docs, lang_col, source_col, text_col)
        often = F.sum("docs").over(Window.partitionBy("lang", "term"))
        kept = scratch.save(counts.withColumn("often", often).where(F.col("term").isNull() | (F.col("often") >= least_docs)).select("lang", "source", "term", "n"), "kept")
        # V and the language's N stand on each of its groups; a null term counts for nothing in either.
        groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        sizes = kept.where("term is not null").select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
        sized = groups.join(langs, "lang").join(sizes, "lang", "left").select("lang", "source", "total", "lang_total", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
        self.groups = scratch.save(sized.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "groups")
        entry = F.struct("source", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
        per_term = kept.where("term is not null").join(self.groups, ["lang", "source"]).groupBy("lang", "term", "lang_total", "v").agg(F.array_sort(F.collect_list(entry)).alias("counts"))
        self.kept_terms = scratch.save(per_term, "terms")  # a term's entries are its sources

    def columns(self) -> DataFrame:
        """``(lang, counts, m)``: the distinct vectors and how many terms have each."""
        return self.kept_terms.groupBy("lang", "counts").agg(F.count("*").alias("m"))

    def pairs(self) -> DataFrame:
        """``(lang, a, b, value)`` of all ordered pairs of a language's sources."""
        gap = lambda x, y: F.abs(F.col(x) - F.col(y))
        columns = self.columns()
        each = columns.select("lang", "m", "counts", F.explode("counts").alias("x"))
        met = each.select("lang", "m", "x", F.explode(F.filter("counts", lambda y: y["source"] > F.col("x.source"))).alias("y"))
        both = gap("x.p", "y.p") - gap("x.p", "y.p0") - gap("x.p0", "y.p") + gap("x.p0", "y.p0")
        shared = met.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(F.col("m") * both).alias("d"))
        # What a source's terms add against another one's p0 depends on their counts alone.
        seen = each.groupBy("lang", F.col("x.source").alias("source"), F.col("x.p").alias("p"), F.col("x.p0").alias("p0")).agg(F.sum("m").alias("m"))
        other = self.groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
        alone = seen.join(other, "lang").where("source <> other").groupBy("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")).agg(F.sum(F.col("m") * (gap("p", "q0") - gap("p0", "q0"))).alias("d"))
        every = self.groups.select("lang", F.col("source").alias("a"), "v", "p0").join(other.withColumnRenamed("other", "b"), "lang").where("a < b")
        absent = every.select("lang", "a", "b", F.when(F.col("v") > 0, F.col("v") * gap("p0", "q0")).otherwise(0).alias("d"))
        half = absent.unionByName(alone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("d").alias("value"))
        way = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")
        return half.select("lang", "value", way).select("lang", "w.a", "w.b", "value")

    def terms(self, top: int = 50) -> DataFrame:
        """``(lang, source, term, value, rank)``: a group's ``top`` terms above their share in the language."""
        first = F.row_number().over(Window.partitionBy("lang", "counts").orderBy("term"))
        few = self.kept_terms.withColumn("r", first).where(F.col("r") <= top)
        in_lang = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
        above = few.select("lang", "term", share(in_lang, F.col("lang_total"), F.col("v")).alias("q"), F.explode("counts").alias("x")).where("x.n > 0 and x.p > q")
        scored = above.select("lang", F.col("x.source").alias("source"), "term", (F.col("x.p") - F.col("q")).alias("value"))
        return scored.withColumn("rank", ranked("term")).where(F.col("rank") <= top)


def ranked(item: str) -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), item))


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Both reports: ``(lang, source, part, item, value, rank)``, part ``pair`` in full and part ``term`` to rank ``top``."""
    audit = Audit(docs, least_docs, lang_col, source_col, text_col)
    pairs = audit.pairs().select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", ranked("item"))
    return pairs.unionByName(audit.terms(top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
