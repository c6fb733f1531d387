"""Cleaning a corpus in five stages: quality, lines, near copies, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
works on all rows its predecessor kept. Rows are told apart by id and text
together, so null and repeated ids are neither missed nor lost. Every stage but the last returns those
columns again; ``run`` writes each result as Parquet and rereads it.

* quality_rules: documents that the weak-supervision verdict or a base rule rejects go.
* line_dedup: lines similar to an earlier line go, ``n_chars`` follows; a document
  that had words and has lost them all goes, for all it said stands earlier.
* near_copies: of each component of 5-word-shingle Jaccard >= 0.8 one row stays,
  of the document with the smallest id (null after all others); rows without
  words all stay.
* decontamination: documents that overlap a benchmark item go.
* packing: each document gets its bucket, batch and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.decontaminate import find_leaks
from spanloom.llm.line_dedup import drop_similar_lines
from spanloom.llm.ngram_join import ngram_jaccard_components
from spanloom.llm.packing import pack, token_lengths
from spanloom.llm.quality import keep_good
from spanloom.llm.scratch import Scratch


def row_name() -> Column:
    """A 64-bit name of a row's id and text, never null."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def has_words() -> Column:
    return F.coalesce(F.length(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", "")) > 0, F.lit(False))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    return keep_good(docs, lambda seen: scratch.save(seen, "votes"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("given"))  # names of the stage's own stay free
    out = drop_similar_lines(packed)
    stays = (F.col("n_removed") == 0) | (F.length(F.regexp_replace("text", "[ \\t\\n\\x0B\\f\\r]+", "")) > 0)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.where(stays).select(*[own.get(c, F.col("given").getField(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "_name")
    named = docs.withColumn(name, row_name())
    once = Scratch(spark, "copies").save(named.where(has_words()).dropDuplicates([name]), "once")
    groups = ngram_jaccard_components(once.select(name, "text"), id_col=name).select(F.col("doc_id").alias(name), "component_id")
    groups = groups.join(once.select(name, "doc_id"), name)
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(name).alias("row"))).alias("m"), F.count("*").alias("n"))
    gone = groups.join(first.where("n > 1"), "component_id").where(F.col(name) != F.col("m.row")).select(name)
    return once.join(gone, name, "left_anti").unionByName(named.where(~has_words())).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "_name")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = find_leaks(docs.select(row_name().alias(name), "text"), benchmark, id_col=name)
    gone = leaks.select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, row_name()).join(gone, name, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_lengths(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Expectation-maximisation and components are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of ``documents`` in ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        kept, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(kept)
    return docs
