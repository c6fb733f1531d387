"""Prediction with worked examples from end to end: examples from a pool, prompts, recorded completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.build import answer, numbered_draws
from ..operators.prompts import conversation, example_prompt, single_document
from ..operators.stats import hash_int
from .annotate import recall


def shown(pool: DataFrame, single_doc: bool, seed: int) -> DataFrame:
    """``(example_id, place, shown struct<item, docs, answer>)`` of ``pool(sample_id, item, docs, selections)``, numbered in draw order.

    With ``single_doc`` an example is one of its documents, picked by a hash, and the selections in it.
    """
    rows = numbered_draws(pool.withColumn("_all", F.lit(0)), "_all", "sample_id", seed).withColumnRenamed("_p", "place")
    docs, selections = F.col("docs"), F.col("selections")
    if single_doc:
        one = F.get("docs", F.pmod(hash_int(F.lit(seed), F.col("sample_id")), F.size("docs")).cast("int"))
        docs = F.array(F.struct(F.lit(0).cast("int").alias("id"), one["text"].alias("text")))
        selections = single_document(F.col("selections"), one["id"])
    return rows.select(F.col("sample_id").alias("example_id"), "place", F.struct("item", docs.alias("docs"), answer(selections).alias("answer")).alias("shown"))


def with_examples(samples: DataFrame, pool: DataFrame, k: int, single_doc: bool = False, randomize: bool = False, seed: int = 42) -> DataFrame:
    """``samples`` with ``examples array<struct<item, docs, answer>>``: ``k`` of the pool, never the sample itself.

    The same first ones for every sample (one in reserve), or, with ``randomize``, places that a hash of the sample's id draws.
    Examples are met by place, so a sample reads k + 1 of the pool and no more.
    """
    rows = shown(pool, single_doc, seed)
    size = rows.agg(F.count("*").alias("_n"))
    if randomize:
        numbered = samples.join(F.broadcast(size), F.lit(True))
        drawn = F.transform(F.sequence(F.lit(0), F.lit(4 * k + 16)), lambda j: F.pmod(hash_int(F.lit(seed), F.col("sample_id"), j), F.col("_n")))
        reserve = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: j.cast("long"))
        places = F.slice(F.array_distinct(F.concat(drawn, reserve)), 1, k + 1)
    else:
        numbered, places = samples, F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: j.cast("long"))
    asked = numbered.select("sample_id", F.posexplode(places).alias("_rank", "place"))
    if not randomize:
        rows = F.broadcast(rows.where(F.col("place") <= k))  # k + 1 rows
    met = asked.join(rows, "place").where("example_id <> sample_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "shown"))).alias("_e"))
    return samples.join(met, "sample_id").withColumn("examples", F.transform(F.slice("_e", 1, k), lambda e: e["shown"])).drop("_e")


def predict_with_examples(samples: DataFrame, pool: DataFrame, completions: DataFrame, model: str, system: str, k: int = 2, single_doc: bool = False, randomize: bool = False, seed: int = 42) -> DataFrame:
    """``(sample_id, conversations, selection)`` of ``samples(sample_id, instruction, item, docs array<struct<id, text>>)``.

    With ``single_doc`` every document is asked for alone, as document 0: ``conversations`` and ``selections`` are arrays in the
    order of the documents. Completions that are not recorded are null.
    """
    rows = with_examples(samples, pool, k, single_doc, randomize, seed)
    if single_doc:
        rows = rows.select("sample_id", "instruction", "item", "examples", F.posexplode("docs").alias("_ord", "d")).withColumn("docs", F.array(F.struct(F.lit(0).cast("int").alias("id"), F.col("d.text").alias("text"))))
    prompt = example_prompt(F.col("instruction"), F.col("item"), F.col("docs"), F.col("examples"))
    asked = rows.withColumns({"model": F.lit(model), "conversations": conversation(prompt, system=F.lit(system))})
    if not single_doc:
        return recall(asked.select("sample_id", "model", "conversations"), completions).select("sample_id", "conversations", F.col("completion").alias("selection"))
    got = recall(asked.select("sample_id", "_ord", "model", "conversations"), completions)
    listed = got.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("_ord", "conversations", "completion"))).alias("r"))
    return listed.select("sample_id", F.col("r.conversations").alias("conversations"), F.col("r.completion").alias("selections"))
