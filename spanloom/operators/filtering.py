"""Which annotated samples are good enough to build on, and their merged answer, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import agreement, ranges

#: Why a sample goes, in the order of the rules; ``beyond_first`` are samples past the first ones of their document set.
REASONS = ("partial_annotators", "low_agreement", "empty_merge", "beyond_first")
MERGED = "Merged"


def sample_ranges(rows: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """The token ranges ``(*keys, doc_id, lo, hi, start_pos, end_pos)`` of rows over ``docs(sample_id, doc_id, text)``; ``keys`` hold the sample's id."""
    return ranges.token_ranges(rows.where("doc_id >= 0"), docs, keys, on=["sample_id", "doc_id"])


def filter_annotated(
    samples: DataFrame,
    groups: DataFrame,
    docs: DataFrame,
    raters: int = 3,
    least_votes: int = 0,
    least_agreement: float | None = None,
    drop_ungrounded: bool = True,
    keep_emptied: bool = False,
    skip_empty: bool = True,
    voters: list[str] | None = None,
    first: int | None = None,
    observation: Observation | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(kept, decisions)``: the groups of the samples that stay, with a group ``Merged``, and what became of each sample.

    ``samples(sample_id, is_negative, set_id, ord)``; ``groups(sample_id, group_id, doc_id, start_pos, end_pos)`` has a row a
    span and a row with null places for a group without spans; ``docs(sample_id, doc_id, text)``.

    Negative samples stay as they are. Of others: spans without a place go and groups left without any (unless ``keep_emptied``);
    a sample with less than ``raters`` groups goes, then one whose groups agree less than ``least_agreement`` on average
    (token F1 of pairs), then, with ``skip_empty``, one in which no token has ``least_votes`` of the ``voters`` (None: all;
    0 votes count as 1). What has the votes becomes the group ``Merged``, which may be empty. Of each set the first
    samples in order stay. ``decisions(sample_id, is_negative, set_id, n_groups, n_dropped, agreement, n_merged, status)``; status is
    null for samples that stay. An ``observation`` counts reasons and dropped groups while decisions are written.
    """
    key = ["sample_id", "group_id"]
    rated = groups.join(samples.where("not is_negative").select("sample_id"), "sample_id", "left_semi")
    places = rated.where("doc_id >= 0") if drop_ungrounded else rated.where("doc_id is not null")
    sized = rated.groupBy(*key).agg(F.count_if((F.col("doc_id") >= 0) if drop_ungrounded else F.col("doc_id").isNotNull()).alias("n"))
    stays = F.lit(True) if keep_emptied or not drop_ungrounded else F.col("n") > 0
    left = sized.withColumn("stays", stays)
    counts = left.groupBy("sample_id").agg(F.count_if("stays").alias("n_groups"), F.count_if(~F.col("stays")).alias("n_dropped"))
    held = left.where("stays").select(*key, "n")

    chosen = sample_ranges(places, docs, key)
    votes = chosen if voters is None else chosen.where(F.col("group_id").isin(voters))
    answer = ranges.vote_ranges(votes, ["sample_id", "doc_id"], least_votes)
    merged = answer.groupBy("sample_id").agg(F.sum("n_tokens").alias("n_merged"))
    pairs = ranges.pair_scores(chosen, held, rater="group_id")

    joined = samples.join(counts, "sample_id", "left").join(agreement.sample_agreement(pairs), "sample_id", "left").join(merged, "sample_id", "left")
    joined = joined.fillna(0, ["n_groups", "n_dropped", "n_merged"])
    low = F.lit(False) if least_agreement is None else F.col("agreement") < least_agreement
    reason = F.when(F.col("is_negative"), None).when(F.col("n_groups") < raters, REASONS[0]).when(low, REASONS[1]).when(F.lit(skip_empty) & (F.col("n_merged") == 0), REASONS[2])
    judged = joined.withColumn("status", reason)
    if first is not None:
        place = F.row_number().over(Window.partitionBy("set_id").orderBy(F.col("status").isNotNull(), "ord", "sample_id"))
        judged = judged.withColumn("status", F.when(F.col("status").isNull() & (place > first), REASONS[3]).otherwise(F.col("status")))
    decisions = judged.select("sample_id", "is_negative", "set_id", "n_groups", "n_dropped", "agreement", "n_merged", "status")
    if observation is not None:
        decisions = decisions.observe(observation, *counters())

    good = decisions.where("status is null").select("sample_id", "is_negative")
    fields = [*key, "doc_id", "start_pos", "end_pos"]
    own = places.unionByName(rated.where("doc_id is null"), allowMissingColumns=True) if not drop_ungrounded else places
    empty = held.where("n = 0").select(*key, *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in fields[2:]])
    own = own.select(*fields) if not drop_ungrounded else own.select(*fields).unionByName(empty)
    answer = answer.select("sample_id", F.lit(MERGED).alias("group_id"), "doc_id", "start_pos", "end_pos")
    none = good.where("not is_negative").join(merged.select("sample_id"), "sample_id", "left_anti").select("sample_id", F.lit(MERGED).alias("group_id"), *[F.lit(None).cast(groups.schema[c].dataType).alias(c) for c in fields[2:]])
    positive = own.unionByName(answer).join(good.where("not is_negative").select("sample_id"), "sample_id", "left_semi").unionByName(none)
    negative = groups.select(*fields).join(good.where("is_negative").select("sample_id"), "sample_id", "left_semi")
    return negative.unionByName(positive), decisions


def counters() -> list[Column]:
    """Counts over decisions, for ``observe`` or an aggregation."""
    return [F.count("*").alias("samples"), F.count_if(F.col("status").isNull()).alias("kept"), *[F.count_if(F.col("status") == r).alias(r) for r in REASONS], F.sum("n_dropped").alias("dropped_groups")]
