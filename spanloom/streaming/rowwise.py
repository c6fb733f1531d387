"""Row-local operators on streams: completions are parsed and scored for errors as they arrive.

Nothing here keeps state, so the same functions serve batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_share, parse_lenient


def parse_stream(completions: DataFrame, column: str = "selection") -> DataFrame:
    """Adds ``spans`` and ``error`` to each completion."""
    return completions.withColumn("spans", parse_lenient(F.col(column))).withColumn("error", error_share(F.col("spans")))


def ground_stream(parsed: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of a stream found verbatim in their sample's static documents (a stream-static equi-join)."""
    each = parsed.select("sample_id", F.posexplode("spans").alias("span_ord", "span")).where("span is not null and span <> ''")
    hit = each.join(docs, "sample_id").where("contains(text, span)")
    return hit.select("sample_id", "span_ord", "doc_id", F.expr("locate(span, text) - 1").alias("start_pos"), F.expr("locate(span, text) - 1 + length(span)").alias("end_pos"))
