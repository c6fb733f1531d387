"""Result rows to reports: normalised metrics, overall scores with intervals, pairs of models, tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bags import bag_f1, numbered
from ..functions.distributions import t_quantile
from ..functions.text import token_count

#: Data sets whose own metric is the token F1, and those with a metric of their own.
OWN_METRIC = ("AspectNews", "DebateSum", "SciFact", "OpenAsp")
TOKEN_METRIC = ("SaliencyDetection", "EvidenceDetection")
ALL_DATASETS = (*OWN_METRIC, *TOKEN_METRIC)


def percent(c: Column) -> Column:
    """A share in percent, rounded half to even at four places first."""
    return F.bround(c, 4) * 100


def interval(rows: DataFrame, value: str, keys: list[str], confidence: float = 0.9) -> DataFrame:
    """``(*keys, n, mean, half_width)`` of Student's interval; nulls count as 0, a single value has no width."""
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.coalesce(value, F.lit(0.0))).alias("mean"), F.stddev_samp(F.coalesce(value, F.lit(0.0))).alias("sd"))
    t = F.when(F.col("n") > 1, t_quantile((1 + confidence) / 2, F.col("n") - 1))
    return stats.select(*keys, "n", "mean", (F.col("sd") / F.sqrt("n") * t).alias("half_width"))


def metric_row(rows: DataFrame) -> DataFrame:
    """Result rows in one form: the data set's own metric as ``orig_*`` (ROUGE-2 where it has one), token scores as ``ext_*``."""
    own = F.col("dataset").isin(*OWN_METRIC)
    bad = F.raise_error(F.concat(F.lit("unknown data set "), "dataset")).cast("double")
    pick = lambda a, b: F.when(own, a).when(F.col("dataset").isin(*TOKEN_METRIC), b).otherwise(bad)
    return rows.select(
        "model", "dataset", pick(F.col("orig_score"), F.col("ext_f1")).alias("orig_score"),
        pick(F.coalesce("rouge2_p", "precision"), F.col("ext_precision")).alias("orig_precision"), pick(F.coalesce("rouge2_r", "recall"), F.col("ext_recall")).alias("orig_recall"),
        "ext_f1", "ext_precision", "ext_recall", "hal", "err",
    )


def complete_models(rows: DataFrame, expected: tuple[str, ...] = ALL_DATASETS, borrowed: tuple[str, ...] = ("AspectNews", "DebateSum")) -> DataFrame:
    """The rows of models that have exactly the expected data sets.

    A ``-sd`` model that lacks only ``borrowed`` ones takes them from its ``-md`` twin.
    """
    lacking = rows.groupBy("model").agg(F.collect_set("dataset").alias("have")).where(F.col("model").endswith("-sd"))
    lacking = lacking.select("model", F.explode(F.array_except(F.array(*[F.lit(b) for b in borrowed]), "have")).alias("dataset"))
    twins = lacking.withColumn("_twin", F.regexp_replace("model", "-sd$", "-md")).join(rows.withColumnRenamed("model", "_twin"), ["_twin", "dataset"]).select(*rows.columns)
    every = rows.unionByName(twins)
    sets = every.groupBy("model").agg(F.array_sort(F.collect_list("dataset")).alias("have"))
    whole = sets.where(F.col("have") == F.array(*[F.lit(d) for d in sorted(expected)])).select("model")
    return every.join(whole, "model", "left_semi")


def overall(rows: DataFrame) -> DataFrame:
    """Macro averages over the data sets of each model."""
    means = [F.avg(c).alias(c) for c in ("ext_f1", "ext_precision", "ext_recall", "orig_score", "orig_precision", "orig_recall", "hal", "err")]
    return rows.groupBy("model").agg(F.count("*").alias("n_datasets"), *means)


def leave_one_out(rows: DataFrame, chosen: dict[str, str], name: str) -> DataFrame:
    """One model's rows from several: for each data set those of the model that left it out, under a common name."""
    picked = F.lit(False)
    for dataset, model in chosen.items():
        picked = picked | (F.col("dataset") == dataset) & (F.col("model") == model)
    return rows.where(picked).withColumn("model", F.lit(name))


def model_pairs(scores: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Paired scores ``(a, b, dataset, sample_id, score_a, score_b)`` of each pair of models, for the tests of :mod:`stats`."""
    wanted = scores.sparkSession.createDataFrame(pairs, "a string, b string")
    left = scores.select(F.col("model").alias("a"), "dataset", "sample_id", F.col("score").alias("score_a"))
    right = scores.select(F.col("model").alias("b"), "dataset", "sample_id", F.col("score").alias("score_b"))
    return left.join(F.broadcast(wanted), "a").join(right, ["b", "dataset", "sample_id"]).select("a", "b", "dataset", "sample_id", "score_a", "score_b")


def paired_tests(scores: DataFrame, pairs: list[tuple[str, str]], draws: int = 1000, confidence: float = 0.9) -> DataFrame:
    """All tests of all pairs of models on all data sets in one plan: a row ``(a, b, dataset)``.

    Means and half-widths of both, whether a's interval lies above b's (``apart``), the signed-rank test of a > b (``w_plus``,
    ``z``, ``p_signed_rank``) and the sign-flip test of a > b (``p_permutation``, null unless a is better).
    """
    from .stats import permutation_test, wilcoxon

    keys = ["a", "b", "dataset"]
    paired = model_pairs(scores, pairs).withColumnRenamed("sample_id", "id")
    sides = [interval(paired, f"score_{x}", keys, confidence).select(*keys, F.col("mean").alias(f"mean_{x}"), F.col("half_width").alias(f"ci_{x}")) for x in "ab"]
    ranks = wilcoxon(paired, "score_b", "score_a", keys).select(*keys, "n", "w_plus", "z", F.col("p").alias("p_signed_rank"))
    flips = permutation_test(paired, "score_b", "score_a", draws, keys=keys).select(*keys, F.col("p").alias("p_permutation"))
    apart = F.col("mean_a") - F.col("ci_a") > F.col("mean_b") + F.col("ci_b")
    return sides[0].join(sides[1], keys).join(ranks, keys).join(flips, keys).withColumn("apart", apart)


def grid(rows: DataFrame, datasets: list[str], values: list[str]) -> DataFrame:
    """A row a model with a block of columns a data set; failed rows (``error`` not null) count as -1."""
    clean = rows.select("model", "dataset", *[F.when(F.col("error").isNotNull(), -1.0).otherwise(F.col(v)).alias(v) for v in values])
    return clean.groupBy("model").pivot("dataset", datasets).agg(*[F.first(v).alias(v) for v in values])


def nearest_other(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each span the least of |lo - other hi| and |hi - other lo| over all others; needs two spans at least."""

    def nearest(asked: np.ndarray, among: np.ndarray) -> np.ndarray:
        order = np.argsort(among, kind="stable")
        values, rank = among[order], np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        at, best = np.searchsorted(values, asked), np.full(len(asked), np.iinfo(np.int64).max)
        for step in (-2, -1, 0, 1):  # two on either side, of which one may be the span's own
            place = at + step
            fit = (place >= 0) & (place < len(values)) & (place != rank)
            best[fit] = np.minimum(best[fit], np.abs(asked[fit] - values[place[fit]]))
        return best

    return np.minimum(nearest(lo, hi), nearest(hi, lo))


def scatter(spans: DataFrame, doc_tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over spans of the way to the nearest other span of its group: ``(*keys, n_spans, scatter)``.

    The way is the tokens between their far ends, by the document's tokens and by its characters, the least over all other
    spans of the document, which may overlap; spans alone in their document among others have 1, a single span of a group
    none. ``spans(*keys, doc_id, lo, hi)`` are first and last tokens, ``doc_tokens(doc_id, n_tokens, n_chars)`` sizes.
    """
    place = F.struct(*keys, "doc_id").alias("g")
    grouped = spans.groupBy(place).agg(F.collect_list(F.col("lo").cast("long")).alias("lo"), F.collect_list(F.col("hi").cast("long")).alias("hi"))

    def run(batches):
        for batch in batches:
            ways = []
            for lo, hi in zip(batch.column(1), batch.column(2), strict=True):
                lo, hi = (x.values.to_numpy() for x in (lo, hi))
                ways.append(nearest_other(lo, hi).tolist() if len(lo) > 1 else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, batch.column(1))), pa.int64()), pa.array(ways, pa.list_(pa.int64()))], ["g", "n", "ways"])

    schema = T.StructType([grouped.schema["g"], T.StructField("n", T.LongType()), T.StructField("ways", T.ArrayType(T.LongType()))])
    near = grouped.mapInArrow(run, schema).select(*[F.col("g")[k].alias(k) for k in keys], F.col("g.doc_id").alias("doc_id"), "n", F.aggregate("ways", F.lit(0.0), lambda a, x: a + x).alias("way"))
    both = near.join(doc_tokens, "doc_id")
    far = F.when(F.col("n") > 1, F.col("way") / F.col("n_tokens") / F.col("n_chars")).otherwise(1.0)
    sums = both.groupBy(*keys).agg(F.sum("n").alias("n_spans"), F.sum(far).alias("_far"))
    return sums.select(*keys, "n_spans", F.when(F.col("n_spans") > 1, F.col("_far") / F.col("n_spans")).alias("scatter"))


def sample_statistics(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """Per sample: source words, and per reference group averages of selections, their words, coverage, compression and density.

    ``refs(sample_id, group_ord, doc_id, content)`` has a row with a null content for a group without selections.
    """
    sources = docs.groupBy("sample_id").agg(F.sum(token_count(F.col("text"))).alias("source_words"), F.count("*").alias("n_docs"))
    words = refs.withColumn("w", F.when(F.col("content").isNotNull(), token_count(F.col("content"))))
    groups = words.groupBy("sample_id", "group_ord").agg(F.count("content").alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("sum_w"), F.coalesce(F.sum(F.col("w") * F.col("w")), F.lit(0)).alias("sq"), F.coalesce(F.median("w"), F.lit(0.0)).alias("med"), F.count_distinct("doc_id").alias("d"))
    both = groups.join(sources, "sample_id")
    density = F.col("sq") / F.when(F.col("sum_w") > 0, F.col("sum_w")).otherwise(1)
    out = both.groupBy("sample_id", "source_words", "n_docs").agg(F.avg("n").alias("selections"), F.avg("sum_w").alias("selected_words"), F.avg("med").alias("median_words"), F.avg(F.col("d") / F.col("n_docs")).alias("coverage"), F.avg(density).alias("density"))
    return out.withColumn("compression", F.col("selected_words") / F.col("source_words"))


def pairwise_similarity(a: DataFrame, b: DataFrame, by_document: bool = True, tokenizer: Callable[[Column], Column] | None = None, metric: Callable[[Column, Column], Column] = bag_f1) -> DataFrame:
    """Similarity of every pair of ``a(a_id, doc_id, content)`` and ``b(b_id, doc_id, content)`` of a sample (``sample_id``).

    ``tokenizer`` makes items of a content (none: it is an array already), ``metric`` a number of two arrays whose items
    are numbered among their equals. With ``by_document``, pairs of different documents score 0.
    """
    items = tokenizer or (lambda c: c)
    side = lambda rows, k, name: rows.select("sample_id", f"{k}_id", F.col("doc_id").alias(f"{k}_doc"), numbered(items(F.col("content"))).alias(name))
    both = side(a, "a", "x").join(side(b, "b", "y"), "sample_id")
    score = metric(F.col("x"), F.col("y"))
    return both.select("sample_id", "a_id", "b_id", (F.when(F.col("a_doc") != F.col("b_doc"), 0.0).otherwise(score) if by_document else score).alias("score"))


def matching_samples(topics: DataFrame, samples: DataFrame) -> DataFrame:
    """Each annotator's row ``(topic, instruction, ...)`` with the sample of that instruction whose id begins with the topic."""
    return topics.join(samples, "instruction").where("startswith(sample_id, topic)")


def consolidated_rating(rows: DataFrame, value: str, keys: list[str], negative: str = "is_negative") -> DataFrame:
    """Ratings 1 to 5 of positive samples recoded to three, with count, mean, deviation and variance."""
    from .agreement import recode

    fit = rows.where((~F.col(negative)) & F.col(value).between(1, 5)).withColumn("_v", recode(F.col(value)))
    return fit.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"), F.var_pop("_v").alias("var"))


def to_markdown(table: DataFrame, places: int = 2) -> str:
    """A small result table as Markdown."""
    head = "| " + " | ".join(table.columns) + " |\n|" + "-|" * len(table.columns)
    cell = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    return "\n".join([head, *("| " + " | ".join(cell(v).replace("|", "\\|") for v in row) + " |" for row in table.collect())])


def to_latex(table: DataFrame, places: int = 2) -> str:
    """A small result table as a LaTeX tabular."""
    special = str.maketrans({c: f"\\{c}" for c in "&%$#_{}"})
    cell = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v).translate(special)
    rows = [" & ".join(map(cell, r)) + r" \\" for r in [table.columns, *table.collect()]]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(table.columns)}}}", rows[0], r"\hline", *rows[1:], r"\end{tabular}"])
