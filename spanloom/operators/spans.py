"""Spans, tokens and islands as DataFrame operators.

Long forms: tokens ``(doc_id, tok, text, start_pos, end_pos)``, spans
``(..., doc_id, start_pos, end_pos)``. Joins are on the document, so tokens of one
document meet only its own spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import match_places

#: Tokens of one document that are handed on together.
TOKENS_AT_ONCE = 1 << 16
#: Documents whose tokens are handed on as arrays together.
DOCUMENTS_AT_ONCE = 128


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a token, numbered from 0 in its document; texts are cut in arrays in the task that holds them."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def run(batches):
        from .ranges import token_bounds

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                starts, ends = token_bounds(text)
                for lo in range(0, len(starts), TOKENS_AT_ONCE):
                    s, e = starts[lo : lo + TOKENS_AT_ONCE], ends[lo : lo + TOKENS_AT_ONCE]
                    named = batch.column(0).take(pa.array(np.full(len(s), i)))
                    words = pa.array([text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.string())
                    yield pa.RecordBatch.from_arrays([named, pa.array(np.arange(lo, lo + len(s), dtype=np.int32)), words, pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["doc_id", "tok", "text", "start_pos", "end_pos"])

    schema = T.StructType([given.schema["doc_id"], T.StructField("tok", T.IntegerType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start_pos", "end_pos")]])
    return given.mapInArrow(run, schema)


def token_arrays(docs: DataFrame) -> DataFrame:
    """``(doc_id, words, starts, ends)`` of ``docs(doc_id, text)`` that have tokens, a row a document, where it stands."""
    given = docs.select("doc_id", "text").where("text is not null")

    def run(batches):
        from .ranges import token_bounds

        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                rows, words, starts, ends = [], [], [], []
                for i in range(at, min(at + DOCUMENTS_AT_ONCE, batch.num_rows)):
                    text = batch.column(1)[i].as_py()
                    s, e = token_bounds(text)
                    if len(s):
                        rows.append(i)
                        words.append([text[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                        starts.append(s.astype(np.int32))
                        ends.append(e.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "words", "starts", "ends"])

    whole = T.ArrayType(T.IntegerType())
    return given.mapInArrow(run, T.StructType([given.schema["doc_id"], T.StructField("words", T.ArrayType(T.StringType())), T.StructField("starts", whole), T.StructField("ends", whole)]))


def covered_tokens(spans: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct ``(*keys, doc_id, tok)`` that spans touch.

    A start in white space takes the token before it, an end there the token after
    it. The first token is the last that begins no later than the span, the last one
    the first that ends no earlier; both numbers are running counts over tokens and
    span ends in order of position, so no token is compared with every span.
    """
    span = F.struct(*keys, F.col("start_pos").alias("_s"), F.col("end_pos").alias("_e"))
    real = spans.where("start_pos >= 0").select("doc_id", span.alias("_span")).distinct()
    none = F.lit(None).cast(real.schema["_span"].dataType).alias("_span")

    def event(rows: DataFrame, at: Column, kind: int, span: Column, end: Column) -> DataFrame:
        return rows.select("doc_id", at.cast("long").alias("_at"), F.lit(kind).alias("_kind"), span, end.cast("long").alias("_end"))

    # In order at one place: ends of spans, tokens by their start, starts of spans.
    no_end = F.lit(None).cast("long")
    events = event(tokens, F.col("start_pos"), 1, none, F.col("end_pos")).unionByName(event(real, F.col("_span._e"), 0, F.col("_span"), no_end)).unionByName(event(real, F.col("_span._s"), 2, F.col("_span"), no_end))
    whole = Window.partitionBy("doc_id").orderBy("_at", "_kind")
    so_far = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.select("doc_id", "_at", "_kind", "_span", F.count("_end").over(so_far).alias("_begun"), F.max("_end").over(so_far).alias("_last"), F.count("_end").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    ended = F.col("_begun") - F.when(F.col("_last") >= F.col("_at"), 1).otherwise(0)
    lo, hi = F.when(F.col("_kind") == 2, F.greatest(F.lit(0), F.col("_begun") - 1)), F.when(F.col("_kind") == 0, F.least(F.col("_n") - 1, ended))
    edges = counted.where("_kind <> 1").groupBy("doc_id", "_span").agg(F.max(lo).alias("_lo"), F.max(hi).alias("_hi"))
    hit = edges.where("_lo <= _hi").select(*[F.col("_span").getField(k).alias(k) for k in keys], "doc_id", F.explode(F.sequence("_lo", "_hi")).alias("tok"))
    return hit.select(*keys, "doc_id", F.col("tok").cast("int").alias("tok")).distinct()


def islands(rows: DataFrame, keys: list[str], position: str, lo: Column, hi: Column) -> DataFrame:
    """Runs of consecutive ``position`` values per key as ``(*keys, start_pos, end_pos)``."""
    order = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_g", F.col(position) - F.row_number().over(order)).groupBy(*keys, "_g").agg(F.min(lo).alias("start_pos"), F.max(hi).alias("end_pos")).drop("_g")


def tokens_to_spans(ids: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Spans over consecutive token ids.

    The ends of each run meet their tokens in a window over both, so tokens dealt by document are not shuffled again.
    """
    order = Window.partitionBy(*keys, "doc_id").orderBy("tok")
    runs = ids.withColumn("_g", F.col("tok") - F.row_number().over(order)).groupBy(*keys, "doc_id", "_g").agg(F.min("tok").alias("_lo"), F.max("tok").alias("_hi"))
    run = F.struct(*keys, "_g").alias("_run")
    ends = runs.select("doc_id", F.explode(F.array("_lo", "_hi")).alias("tok"), run)
    none = F.lit(None).cast(ends.schema["_run"].dataType).alias("_run")
    no_place = [F.lit(None).cast("int").alias(c) for c in ("start_pos", "end_pos")]
    rows = tokens.select("doc_id", F.col("tok").cast("int").alias("tok"), none, "start_pos", "end_pos").unionByName(ends.select("doc_id", F.col("tok").cast("int").alias("tok"), "_run", *no_place))
    here = Window.partitionBy("doc_id", "tok")
    placed = rows.select("doc_id", "_run", F.max("start_pos").over(here).alias("_s"), F.max("end_pos").over(here).alias("_e")).where("_run is not null")
    out = placed.groupBy("doc_id", "_run").agg(F.min("_s").alias("start_pos"), F.max("_e").alias("end_pos"))
    return out.select(*[F.col("_run").getField(k).alias(k) for k in keys], "doc_id", "start_pos", "end_pos")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The union of spans per key: overlapping and adjacent spans become one."""
    order = Window.partitionBy(*keys).orderBy("start_pos", "end_pos").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.withColumn("_new", (F.col("start_pos") > F.coalesce(F.max("end_pos").over(order), F.lit(-1))).cast("int"))
    grouped = starts.withColumn("_g", F.sum("_new").over(Window.partitionBy(*keys).orderBy("start_pos", "end_pos")))
    return grouped.groupBy(*keys, "_g").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("_g")


def intersect_spans(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Characters in both span sets, as merged spans: where both of the merged sets are open, by running sums over their ends."""
    parts = [merge_spans(x.select(*keys, "start_pos", "end_pos"), keys) for x in (a, b)]
    ends = None
    for side, x in enumerate(parts):
        for at, step in (("start_pos", 1), ("end_pos", -1)):
            e = x.select(*keys, F.col(at).alias("_at"), F.lit(step if side == 0 else 0).alias("_a"), F.lit(step if side == 1 else 0).alias("_b"))
            ends = e if ends is None else ends.unionByName(e)
    ends = ends.groupBy(*keys, "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    order = Window.partitionBy(*keys).orderBy("_at")
    state = ends.select(*keys, F.col("_at").alias("start_pos"), F.lead("_at").over(order).alias("end_pos"), F.sum("_a").over(order).alias("_x"), F.sum("_b").over(order).alias("_y"))
    return merge_spans(state.where("_x > 0 and _y > 0").select(*keys, "start_pos", "end_pos"), keys)


def vote(ids: DataFrame, keys: list[str], rater: str, least: int) -> DataFrame:
    """``(*keys, doc_id, tok)`` that at least ``least`` raters chose (0 counts as 1)."""
    return ids.groupBy(*keys, "doc_id", "tok").agg(F.countDistinct(rater).alias("_v")).where(F.col("_v") >= max(1, least)).drop("_v")


def characters(spans: DataFrame) -> DataFrame:
    """One row per character of each span; overlaps repeat."""
    return spans.where("end_pos > start_pos").withColumn("char", F.explode(F.expr("sequence(start_pos, end_pos - 1)"))).drop("start_pos", "end_pos")


def highlights(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Alternating plain and marked segments of each document: ``(doc_id, start_pos, end_pos, marked)``."""
    merged = merge_spans(spans.where("doc_id >= 0"), ["doc_id"])
    order = Window.partitionBy("doc_id").orderBy("start_pos")
    marked = merged.withColumn("marked", F.lit(True))
    gaps = merged.select("doc_id", F.coalesce(F.lag("end_pos").over(order), F.lit(0)).alias("_s"), F.col("start_pos").alias("end_pos")).select("doc_id", F.col("_s").alias("start_pos"), "end_pos")
    ends = docs.select("doc_id", F.length("text").alias("n")).join(merged.groupBy("doc_id").agg(F.max("end_pos").alias("e")), "doc_id", "left")
    tail = ends.select("doc_id", F.coalesce("e", F.lit(0)).alias("start_pos"), F.col("n").alias("end_pos"))
    plain = gaps.unionByName(tail).where("end_pos > start_pos").withColumn("marked", F.lit(False))
    return marked.unionByName(plain)


def last_header_before(spans: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """As-of join: each span with the last header that begins before its end, and offsets relative to the header's end."""
    head = F.struct(F.col("start_pos").alias("_hs"), F.col("end_pos").alias("_he"), "header")
    marks = headers.select(key, F.col("start_pos").alias("_at"), F.lit(1).alias("_kind"), head.alias("_h"), F.lit(None).cast("int").alias("start_pos"), F.lit(None).cast("int").alias("end_pos"))
    ask = spans.select(key, F.col("end_pos").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(marks.schema["_h"].dataType).alias("_h"), "start_pos", "end_pos").distinct()
    # At one place spans come first: a header that begins at a span's end is not before it.
    so_far = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = marks.unionByName(ask).withColumn("h", F.max("_h").over(so_far)).where("_kind = 0 and h is not null")
    return best.select(key, "h.header", (F.col("start_pos") - F.col("h._he")).alias("start_pos"), (F.col("end_pos") - F.col("h._he")).alias("end_pos"))


def nearest_gap(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the mean over spans of the distance to the nearest other span (0 if they touch); null for a single span.

    Of the spans that begin earlier the one that ends last is nearest, of those that begin later the first.
    """
    each = spans.select(*keys, F.col("start_pos").alias("s"), F.col("end_pos").alias("e")).distinct()
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.col("s") - F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("s").over(order) - F.col("e")
    gaps = each.select(*keys, F.greatest(F.lit(0), F.least(before, after)).alias("g"), F.least(before, after).alias("m")).where("m is not null")
    return gaps.groupBy(*keys).agg(F.sum("g").alias("gap_sum"), F.count("*").alias("n_spans"))


def by_header(spans: DataFrame, texts: DataFrame, pattern: str, key: str = "sample_id") -> DataFrame:
    """Spans of a text of several documents as spans of the documents: ``spans`` with ``doc_id`` and rebased offsets.

    ``texts(key, text)`` sets each document under a header that matches ``pattern``, whose first group is the document's number.
    A span belongs to the last header that ends no later than the span does. In a text that does not begin with a
    header (white space aside) spans are of document 0 and keep their offsets; where no header stands before a span, its document is null.
    """
    found = texts.select(key, F.col("text").rlike(rf"(?s)\A(?U:\s)*(?:{pattern})").alias("_many"), match_places(F.col("text"), pattern).alias("_h"))
    several = found.select(key, F.explode("_h").alias("h"), "_many").where("_many")
    number = F.regexp_extract("h.content", pattern, 1).cast("int")
    kind = T.StructType().add("at", "integer").add("doc_id", "integer")
    marks = several.select(key, F.col("h.end_pos").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("h.end_pos").alias("at"), number.alias("doc_id")).alias("_m"), *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in spans.columns if c != key])
    rest = [c for c in spans.columns if c != key]
    asked = spans.select(key, F.col("end_pos").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_m"), *rest)
    # At one place headers come first: one that ends where a span ends stands before it.
    so_far = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marks.unionByName(asked).withColumn("_l", F.max("_m").over(so_far)).where("_kind = 1")
    both = last.join(found.select(key, "_many"), key, "left")
    doc, shift = F.when(F.col("_many"), F.col("_l.doc_id")).otherwise(0), F.when(F.col("_many"), F.col("_l.at")).otherwise(0)
    moved = [(F.col(c) - shift).alias(c) if c in ("start_pos", "end_pos") else F.col(c) for c in rest if c != "doc_id"]
    return both.select(key, doc.alias("doc_id"), *moved)
