"""Agreement between annotators: pairwise scores, medoids, votes and kappas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import prf


def pair_scores(ids: DataFrame, raters: DataFrame, with_self: bool = False, ordered: bool = False) -> DataFrame:
    """F1 of every pair of raters of a sample: ``(sample_id, a, b, overlap, n_a, n_b, f1)``.

    ``raters(sample_id, rater)`` lists all raters, those with nothing chosen
    included; ``ids(sample_id, rater, doc_id, tok)`` is distinct. Pairs are a < b
    unless ``ordered``; ``with_self`` adds (a, a).
    """
    keep = ((F.col("a") != F.col("b")) if ordered else (F.col("a") < F.col("b"))) | ((F.col("a") == F.col("b")) if with_self else F.lit(False))
    pairs = raters.select("sample_id", F.col("rater").alias("a")).join(raters.select("sample_id", F.col("rater").alias("b")), "sample_id").where(keep)
    # Who chose a token is one row; its pairs of raters, each with itself too, give all overlaps and sizes at once.
    who = ids.groupBy("sample_id", "doc_id", "tok").agg(F.collect_set("rater").alias("_who"))
    met = who.select("sample_id", F.explode("_who").alias("a"), "_who").select("sample_id", "a", F.explode("_who").alias("b"))
    counts = met.groupBy("sample_id", "a", "b").agg(F.count("*").alias("n"))
    tables = counts.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "n"))).alias("_n"))
    of = lambda x, y: F.coalesce(F.try_element_at("_n", F.struct(F.col(x).alias("a"), F.col(y).alias("b"))), F.lit(0).cast("long"))
    scored = pairs.join(tables, "sample_id", "left").select("sample_id", "a", "b", of("a", "b").alias("overlap"), of("a", "a").alias("n_a"), of("b", "b").alias("n_b"))
    return scored.withColumn("f1", prf(F.col("overlap"), F.col("n_a"), F.col("n_b"))["f1"])


def sample_agreement(pairs: DataFrame) -> DataFrame:
    """Mean pairwise F1 of each sample."""
    return pairs.groupBy("sample_id").agg(F.avg("f1").alias("agreement"))


def agreement_report(pairs: DataFrame) -> DataFrame:
    """Mean F1 overall, by rater and by pair in one pass of grouping sets: ``(level, name, f1, n)``."""
    long = pairs.select("f1", F.explode(F.array(F.struct(F.lit("all").alias("level"), F.lit("").alias("name")), F.struct(F.lit("rater").alias("level"), F.col("a").cast("string").alias("name")), F.struct(F.lit("rater").alias("level"), F.col("b").cast("string").alias("name")), F.struct(F.lit("pair").alias("level"), F.concat_ws("-", "a", "b").alias("name")))).alias("g"))
    return long.groupBy("g.level", "g.name").agg(F.avg("f1").alias("f1"), F.count("*").alias("n"))


def medoid(pairs: DataFrame) -> DataFrame:
    """Per sample the rater with the best mean F1 to all raters, itself included; the first on ties (to nine places, so that the order of a sum decides nothing)."""
    means = pairs.groupBy("sample_id", "a").agg(F.round(F.avg("f1"), 9).alias("f1"))
    return means.groupBy("sample_id").agg(F.max(F.struct("f1", (-F.col("a")).alias("o"))).alias("m")).select("sample_id", (-F.col("m.o")).alias("rater"), F.col("m.f1").alias("f1"))


def kappa(ratings: DataFrame, x: str, y: str, levels: int, weights: str | None = None, close_is_same: bool = False) -> DataFrame:
    """Cohen's kappa of two integer ratings in 0..levels-1: ``(observed, expected, kappa)`` as weighted disagreements.

    ``weights`` is None (any difference counts 1), ``linear`` or ``quadratic``;
    ``close_is_same`` forgives a difference of one. Null where chance agreement is perfect.
    """
    both = ratings.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = both.groupBy(F.col(x).alias("i"), F.col(y).alias("j")).agg(F.count("*").alias("n"))
    rows, cols = counts.groupBy("i").agg(F.sum("n").alias("r")), counts.groupBy("j").agg(F.sum("n").alias("c"))
    gap = F.abs(F.col("i") - F.col("j"))
    if close_is_same:
        gap = F.greatest(F.lit(0), gap - 1)
    weight: Column = {None: (gap > 0).cast("int"), "linear": gap, "quadratic": gap * gap}[weights]
    # Margins have one row a level, so this product has levels^2 rows at most.
    grid = rows.join(F.broadcast(cols.where(F.col("j").between(0, levels - 1))), F.lit(True)).join(counts, ["i", "j"], "left").fillna(0, ["n"])
    total = grid.agg(F.sum("n").alias("n"), F.sum(weight * F.col("n")).alias("o"), F.sum(weight * F.col("r") * F.col("c")).alias("e"))
    return total.select(F.col("o").alias("observed"), F.col("e").alias("expected"), F.when(F.col("e") > 0, 1 - F.col("o") * F.col("n") / F.col("e")).alias("kappa"))


def recode(rating: Column) -> Column:
    """Five levels to three; anything outside 1..5 is null."""
    return F.when(rating.isin(1, 2), 1).when(rating == 3, 2).when(rating.isin(4, 5), 3)
