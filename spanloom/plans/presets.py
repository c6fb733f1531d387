"""Data sets from annotated samples by preset: filter, merge, split, answers and conversations, stage by stage."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agreement, build, filtering, loaders, ranges
from ..operators.prompts import conversation
from .stages import Stage, Stages


@dataclass(frozen=True)
class Preset:
    """How many votes a merged token needs, which group answers, how many samples a document set gives, and whose spans count."""

    least_votes: int = 1
    mode: str = "merge"
    first: int | None = None
    drop_ungrounded: bool = True
    voters: tuple[str, ...] | None = None
    raters: int = 3
    skip_empty: bool = False


#: The presets by name.
PRESETS = {
    "majority": Preset(least_votes=2),
    "union": Preset(),
    "gpt4": Preset(mode="model:GPT4"),
    "intersect": Preset(least_votes=3),
    "baseline": Preset(mode="model:GPT4", first=1, drop_ungrounded=False),
    "baseline-k5": Preset(mode="model:GPT4", first=5, drop_ungrounded=False),
    "k1-union": Preset(first=1),
    "k2-union": Preset(first=2),
    "k3-union": Preset(first=3),
    "k4-union": Preset(first=4),
    "union-gpt4-gemini": Preset(voters=("GPT4", "Gemini-1.5")),
    "single-step": Preset(mode="model:GPT4", first=1, raters=1),
}
SOURCE = "ReverseInstructions"


def kept_groups(samples: DataFrame, groups: DataFrame, docs: DataFrame, **settings) -> DataFrame:
    return filtering.filter_annotated(samples, groups, docs, **settings)[0]


def set_splits(samples: DataFrame, seed: int) -> DataFrame:
    """``(set_id, type, split)``: 70, 10 and 20 % of the document sets of each type."""
    sets = samples.groupBy("set_id").agg(F.min("type").alias("type"))
    return build.stratified_split(sets, "type", "set_id", seed=seed)


def answers(samples: DataFrame, kept: DataFrame, docs: DataFrame, splits: DataFrame, mode: str) -> DataFrame:
    """``(sample_id, set_id, type, split, group_id, selections)`` of the kept samples that have an answer under ``mode``.

    Negative samples stay, without selections. ``best`` takes the group nearest to the others.
    """
    stays = kept.select("sample_id", "group_id").distinct().join(samples.select("sample_id", "is_negative"), "sample_id")
    if mode == "best":
        own = kept.where(F.col("group_id") != filtering.MERGED)
        # Raters as numbers in the order of their names, as medoids are told by number.
        names = own.groupBy("sample_id").agg(F.sort_array(F.collect_set("group_id")).alias("_names"))
        number = lambda rows: rows.join(names, "sample_id").withColumn("rater", F.array_position("_names", F.col("group_id")).cast("int"))
        chosen = number(filtering.sample_ranges(own, docs, ["sample_id", "group_id"]))
        raters = number(own.select("sample_id", "group_id").distinct())
        half = ranges.pair_scores(chosen, raters).select("sample_id", "a", "b", "f1")
        self_ = raters.select("sample_id", F.col("rater").alias("a"), F.col("rater").alias("b"), F.lit(1.0).alias("f1"))
        pairs = half.unionByName(half.select("sample_id", F.col("b").alias("a"), F.col("a").alias("b"), "f1")).unionByName(self_)
        medoids = agreement.medoid(pairs).join(names, "sample_id").select("sample_id", F.element_at("_names", F.col("rater")).alias("group_id"))
    else:
        medoids = stays.where("false").select("sample_id", "group_id")
    chosen = loaders.answer_group(stays.withColumn("source_dataset", F.lit(SOURCE if mode != "best" else "")), medoids, mode)
    # Negatives answer nothing; their groups stay without spans.
    negative = samples.where("is_negative").join(kept.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", F.lit(None).cast("string").alias("group_id"))
    picked = chosen.join(samples.where("not is_negative").select("sample_id"), "sample_id", "left_semi").unionByName(negative)
    placed = kept.where("doc_id >= 0").join(picked.where("group_id is not null"), ["sample_id", "group_id"], "left_semi").join(docs, ["sample_id", "doc_id"])
    span = F.struct("doc_id", "start_pos", "end_pos", F.expr("substr(text, start_pos + 1, end_pos - start_pos)").alias("content"))
    listed = placed.groupBy("sample_id").agg(F.array_sort(F.collect_list(span)).alias("selections"))
    none = F.array().cast(listed.schema["selections"].dataType)
    rows = picked.join(samples.select("sample_id", "set_id"), "sample_id").join(splits.select("set_id", "type", "split"), "set_id").join(listed, "sample_id", "left")
    return rows.select("sample_id", "set_id", "type", "split", "group_id", F.coalesce("selections", none).alias("selections"))


def conversations(rows: DataFrame, samples: DataFrame, docs: DataFrame, system: str) -> DataFrame:
    """``(sample_id, split, conversations)``: instruction and documents, and the answer."""
    texts = docs.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("id"), "text"))).alias("docs"))
    both = rows.join(samples.select("sample_id", "instruction"), "sample_id").join(texts, "sample_id")
    from ..functions.text import format_documents

    prompt = F.concat("instruction", F.lit("\n\n"), format_documents(F.col("docs"), "Doc"))
    return both.select("sample_id", "split", conversation(prompt, build.answer(F.col("selections")), F.lit(system)).alias("conversations"))


def build_preset(stages: Stages, name: str, system: str = "", seed: int = 42) -> dict[str, DataFrame]:
    """The tables of a preset from the sources ``samples(sample_id, set_id, ord, type, is_negative, instruction)``, ``groups`` and ``docs``.

    Presets that filter alike share the filtered table, all share the splits.
    """
    p = asdict(PRESETS[name])
    mode = p.pop("mode")
    p["voters"] = list(p["voters"]) if p["voters"] else None
    return stages.run(
        Stage("splits", set_splits, ("samples",), {"seed": seed}),
        Stage("filtered", kept_groups, ("samples", "groups", "docs"), p),
        Stage("answers", answers, ("samples", "filtered", "docs", "splits"), {"mode": mode}),
        Stage("conversations", conversations, ("answers", "samples", "docs"), {"system": system}),
    )
