"""Grounding: where in the documents a span stands, or that it stands nowhere.

Searches over a whole corpus are blocked: an exact hit shares every inner run of
``ANCHOR`` words with its document, so a span joins on the hash of one such run and
only then is looked up. Spans too short for an anchor are compared with every
text in a nested loop; their number is the caller's to bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, strip

ANCHOR = 4
MODES = {"exact_match": lambda c: c, "normalized_match": normalize}


def _words(c: Column) -> Column:
    return F.split(c, r"(?U)\s+")


def _anchor(words: str) -> Column:
    """The hash of the inner words 1..ANCHOR of a span with ANCHOR + 2 words at least, else null."""
    inner = F.transform(F.slice(words, 2, ANCHOR), lambda x: F.xxhash64(x))
    return F.when(F.size(words) >= ANCHOR + 2, F.xxhash64(*[F.get(inner, F.lit(j)) for j in range(ANCHOR)]))


def _runs(hashes: str) -> Column:
    """The distinct hashes of all runs of ANCHOR words, from the words' hashes in a column."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(ANCHOR))
    runs = F.expr(f"transform(sequence(0, size({hashes}) - {ANCHOR}), i -> xxhash64({parts}))")
    return F.when(F.size(hashes) >= ANCHOR, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def occurrences(spans: DataFrame, docs: DataFrame, form: Callable[[Column], Column] = MODES["exact_match"]) -> DataFrame:
    """All ``(span_id, doc_id, start_pos, end_pos, content)``, first occurrence per document; blank spans have none."""
    needle = spans.where(F.length(strip(F.col("span"))) > 0).select("span_id", form(F.col("span")).alias("_s")).withColumn("_w", _words(F.col("_s")))
    needle = needle.select("span_id", "_s", _anchor("_w").alias("_a"))
    hay = docs.select("doc_id", F.col("text").alias("_text"), form(F.col("text")).alias("_t"))
    runs = hay.select("doc_id", F.transform(_words(F.col("_t")), lambda x: F.xxhash64(x)).alias("_h")).select("doc_id", F.explode(_runs("_h")).alias("_a"))
    near = needle.where("_a is not null").join(runs, "_a").select("span_id", "_s", "doc_id").join(hay, "doc_id").where("contains(_t, _s)")
    short = needle.where("_a is null").drop("_a").join(hay, F.expr("contains(_t, _s)"))
    found = near.select("span_id", "_s", "doc_id", "_t", "_text").unionByName(short.select("span_id", "_s", "doc_id", "_t", "_text"))
    start = F.expr("locate(_s, _t) - 1")
    return found.select("span_id", "doc_id", start.alias("start_pos"), (start + F.length("_s")).alias("end_pos"), F.expr("substr(_text, locate(_s, _t), length(_s))").alias("content"))


def first_match(hits: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row a span: the hinted document if it has the span, else the first; ``total_count`` documents have it."""
    rank = F.col("doc_id")
    if hints is not None:
        hits = hits.join(hints.select("span_id", F.col("doc_id").alias("_hint")), "span_id", "left")
        hits = hits.withColumn("_far", (~F.col("doc_id").eqNullSafe(F.col("_hint"))).cast("int"))
    else:
        hits = hits.withColumn("_far", F.lit(0))
    best = F.min(F.struct("_far", rank, "start_pos", "end_pos", "content")).alias("m")
    return hits.groupBy("span_id").agg(best, F.count("*").alias("total_count")).select("span_id", "m.doc_id", "m.start_pos", "m.end_pos", "m.content", "total_count")


def ground(spans: DataFrame, docs: DataFrame, modes: tuple[str, ...] = ("exact_match", "normalized_match"), hints: DataFrame | None = None, fuzzy: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``spans(span_id, span)`` against ``docs(doc_id, text)``, mode by mode; the first mode that hits wins.

    Blank spans get mode ``whitespace``, spans found nowhere ``hallucination``, both
    with -1 for document and offsets. ``fuzzy`` is tried last.
    """
    blank = spans.where(F.length(strip(F.col("span"))) == 0)
    rest = spans.where(F.length(strip(F.col("span"))) > 0)
    out = None
    for mode in modes:
        hit = first_match(occurrences(rest, docs, MODES[mode]), hints).withColumn("mode", F.lit(mode)).withColumn("best_dist", F.lit(None).cast("int"))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select("span_id"), "span_id", "left_anti")
    if fuzzy is not None:
        hit = fuzzy(rest, docs).withColumn("mode", F.lit("fuzzy_match"))
        out = out.unionByName(hit) if out is not None else hit
        rest = rest.join(hit.select("span_id"), "span_id", "left_anti")

    def nowhere(df: DataFrame, mode: str) -> DataFrame:
        minus = F.lit(-1)
        return df.select("span_id", minus.cast(docs.schema["doc_id"].dataType).alias("doc_id"), minus.alias("start_pos"), minus.alias("end_pos"), F.col("span").alias("content"), F.lit(0).cast("long").alias("total_count"), F.lit(mode).alias("mode"), F.lit(None).cast("int").alias("best_dist"))

    lost = nowhere(rest, "hallucination").unionByName(nowhere(blank, "whitespace"))
    return lost if out is None else out.unionByName(lost)


def mode_histogram(grounded: DataFrame) -> DataFrame:
    return grounded.groupBy("mode").agg(F.count("*").alias("n"))


def hallucination_rate(grounded: DataFrame) -> DataFrame:
    """Hallucinations over all spans, blank ones included; null without spans."""
    n = F.count("*")
    return grounded.agg(F.count_if(F.col("mode") == "hallucination").alias("n_hallucinated"), n.alias("n_spans"), F.when(n > 0, F.count_if(F.col("mode") == "hallucination") / n).alias("rate"))
