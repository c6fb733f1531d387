"""Annotating samples from recorded completions: instructions by one model, their selections by several, grounded and told apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bags import bag_scores, numbered
from ..functions.repair import parse_instruction_map, parse_numbered
from ..functions.text import normalize_answer
from ..operators.prompts import conversation, selection_prompt
from ..sources.files import cache_key
from .evaluate import ground_instructions

NEGATIVE = "Negative"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _numbered_list(raw: pd.Series) -> pd.Series:
    return raw.map(lambda s: parse_numbered(s) or None if isinstance(s, str) else None)


def recall(prompts: DataFrame, completions: DataFrame) -> DataFrame:
    """``prompts(model, conversations, ...)`` with their recorded ``completion``; all models in one join."""
    keyed = prompts.withColumn("key", cache_key(F.struct("model", "conversations")))
    return keyed.join(completions.select("key", "completion"), "key", "left").drop("key")


def generate(samples: DataFrame, completions: DataFrame, model: str, prompt: Column, system: str | None = None) -> DataFrame:
    """``samples`` with ``instructions``, the topics of the model's numbered list (null: no completion, or none in it)."""
    asked = samples.withColumns({"model": F.lit(model), "conversations": conversation(prompt, system=F.lit(system) if system else None)})
    return recall(asked, completions).withColumn("instructions", _numbered_list(F.col("completion"))).drop("model", "conversations", "completion")


def select(samples: DataFrame, completions: DataFrame, models: list[str], guide: Column, n: int = 5) -> DataFrame:
    """``(sample_id, model, status, selections)``: each model's map from instruction to texts; ``missing``, ``unreadable`` or ``read``."""
    prompt = selection_prompt(guide, F.col("instructions"), F.col("docs"), F.col("type") == "code")
    asked = samples.where("instructions is not null").withColumn("model", F.explode(F.array(*map(F.lit, models)))).withColumn("conversations", conversation(prompt))
    got = recall(asked, completions).withColumn("selections", parse_instruction_map(F.col("completion"), n))
    status = F.when(F.col("completion").isNull(), "missing").when(F.col("selections").isNull(), "unreadable").otherwise("read")
    return got.select("sample_id", "model", "instructions", "is_negative", status.alias("status"), "selections")


def matched(selected: DataFrame) -> DataFrame:
    """A model's instructions by place: ``(sample_id, model, is_negative, ord, instruction, model_instruction, differs)``; ``status`` is ``unequal`` where numbers differ.

    A model may say the number of an instruction; other words differ if F1 and recall are under a half.
    """
    said = F.map_keys("selections")
    pairs = F.when(F.size("instructions") == F.size(said), F.arrays_zip(F.col("instructions").alias("a"), said.alias("b")))
    each = selected.where("status = 'read'").select("sample_id", "model", "is_negative", pairs.cast("array<struct<a:string,b:string>>").alias("p"))
    rows = each.select("sample_id", "model", "is_negative", F.posexplode_outer("p").alias("ord", "x")).select("sample_id", "model", "is_negative", "ord", F.col("x.a").alias("instruction"), F.col("x.b").alias("model_instruction"))
    words = lambda c: numbered(F.filter(F.split(normalize_answer(F.col(c)), " "), lambda w: w != ""))
    scored = rows.withColumn("_a", words("instruction")).withColumn("_b", words("model_instruction"))
    scores = bag_scores(F.col("_a"), F.col("_b"))
    differs = ~F.col("model_instruction").rlike("^[0-5]$") & (scores["f1"] < 0.5) & (scores["recall"] < 0.5)
    return scored.withColumn("differs", differs).withColumn("status", F.when(F.col("ord").isNull(), "unequal").otherwise("matched")).drop("_a", "_b")


def annotate(samples: DataFrame, completions: DataFrame, models: list[str], guide: Column, fuzzy: bool = True, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(groups, report)`` of ``samples(sample_id, type, is_negative, docs array<struct<id, filename, text>>, instructions)``.

    ``groups(inst_id, sample_id, ord, instruction, is_negative, group_id, doc_id, start_pos, end_pos, mode)``: a row a
    grounded span, and one with null places for a model that selects nothing; negative samples have one empty group for
    each instruction. ``report(sample_id, model, status, n_differs)`` tells what became of each completion.
    """
    selected = select(samples, completions, models, guide, n)
    pairs = matched(selected)
    docs = samples.select("sample_id", F.explode("docs").alias("d")).select("sample_id", F.col("d.id").alias("doc_id"), "d.text")
    placed = ground_instructions(selected.where("status = 'read' and not is_negative").select("sample_id", "model", "selections"), docs, ["model"], fuzzy)
    mine = pairs.where("status = 'matched' and not is_negative")
    spans = placed.withColumnRenamed("instruction", "model_instruction").select("sample_id", "model", "model_instruction", "span_ord", "doc_id", "start_pos", "end_pos", "mode")
    full = mine.join(spans, ["sample_id", "model", "model_instruction"], "left").select("sample_id", "ord", "instruction", "is_negative", F.col("model").alias("group_id"), "doc_id", "start_pos", "end_pos", "mode")
    none = {c: F.lit(None).cast(full.schema[c].dataType) for c in ("doc_id", "start_pos", "end_pos", "mode")}
    negative = samples.where("is_negative").select("sample_id", F.posexplode("instructions").alias("ord", "instruction"), "is_negative", F.lit(NEGATIVE).alias("group_id")).withColumns(none)
    groups = full.unionByName(negative.select(*full.columns)).withColumn("inst_id", F.concat("sample_id", F.lit(".inst-"), F.col("ord").cast("string")))
    seen = pairs.groupBy("sample_id", "model").agg(F.count_if("differs").alias("n_differs"), F.max("status").alias("s"))
    report = selected.select("sample_id", "model", "status").join(seen, ["sample_id", "model"], "left")
    return groups, report.select("sample_id", "model", F.when(F.col("s") == "unequal", "unequal").otherwise(F.col("status")).alias("status"), F.coalesce("n_differs", F.lit(0).cast("long")).alias("n_differs"))
