"""Scores of predicted against reference selections."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def prf(overlap: Column, n_ref: Column, n_pred: Column) -> dict[str, Column]:
    """Precision, recall, F1 and IoU of sets from their sizes; two empty sets agree, one empty set scores 0."""
    none = (n_ref == 0) & (n_pred == 0)
    safe = lambda a, b: F.when(none, 1.0).when(overlap == 0, 0.0).otherwise(a / b)
    return {"precision": safe(overlap, n_pred), "recall": safe(overlap, n_ref), "f1": safe(2.0 * overlap, n_ref + n_pred), "iou": safe(overlap * 1.0, n_ref + n_pred - overlap)}


def bag_overlap(ref: DataFrame, pred: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Multiset overlap per key: ``(*keys, overlap, n_ref, n_pred)``; keys present on one side only count as empty on the other."""
    a = ref.groupBy(*keys, item).agg(F.count("*").alias("_r"))
    b = pred.groupBy(*keys, item).agg(F.count("*").alias("_p"))
    both = a.join(b, [*keys, item], "full").fillna(0, ["_r", "_p"])
    return both.groupBy(*keys).agg(F.sum(F.least("_r", "_p")).alias("overlap"), F.sum("_r").alias("n_ref"), F.sum("_p").alias("n_pred"))


def score_groups(ref_ids: DataFrame, pred_ids: DataFrame, groups: DataFrame) -> DataFrame:
    """Token scores of each sample's prediction against each of its reference groups.

    ``groups(sample_id, group_ord)`` lists the references (empty ones included);
    token ids are ``(sample_id, group_ord, doc_id, tok)`` and ``(sample_id, doc_id, tok)``.
    """
    # Each side is read once: a window over a token's marks tells whether it is predicted, counts per sample carry the rest.
    marks = ref_ids.select("sample_id", "doc_id", "tok", "group_ord", F.lit(0).alias("_p")).unionByName(pred_ids.select("sample_id", "doc_id", "tok", F.lit(None).cast(groups.schema["group_ord"].dataType).alias("group_ord"), F.lit(1).alias("_p")))
    seen = marks.withColumn("_hit", F.max("_p").over(Window.partitionBy("sample_id", "doc_id", "tok")))
    counts = seen.groupBy("sample_id", "group_ord").agg(F.count("*").alias("n"), F.sum("_hit").alias("o"))
    each = F.when(F.col("group_ord").isNotNull(), F.struct("group_ord", "n", "o"))
    totals = counts.groupBy("sample_id").agg(F.max(F.when(F.col("group_ord").isNull(), F.col("n"))).alias("n_pred"), F.collect_list(each).alias("_g"))
    mine = F.get(F.filter("_g", lambda g: g["group_ord"] == F.col("group_ord")), F.lit(0))
    sized = groups.join(totals, "sample_id", "left").withColumn("_m", mine)
    sized = sized.select(*groups.columns, F.col("_m.n").alias("n_ref"), "n_pred", F.col("_m.o").alias("overlap")).fillna(0, ["n_ref", "n_pred", "overlap"])
    return sized.select("*", *[c.alias(k) for k, c in prf(F.col("overlap"), F.col("n_ref"), F.col("n_pred")).items()])


def best_group(scored: DataFrame, by: str = "f1") -> DataFrame:
    """Per sample the reference group with the best score, the first on ties."""
    rest = [c for c in scored.columns if c not in ("sample_id", "group_ord")]
    return scored.groupBy("sample_id").agg(F.max(F.struct(F.col(by).alias("_by"), (-F.col("group_ord")).alias("_o"), *rest)).alias("m")).select("sample_id", (-F.col("m._o")).alias("group_ord"), *[F.col(f"m.{c}") for c in rest])


def summary(scored: DataFrame, metrics: tuple[str, ...] = ("f1", "iou", "precision", "recall")) -> DataFrame:
    """Means over samples (missing scores count 0) and the sample count."""
    return scored.agg(F.count("*").alias("n"), *[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in metrics])


def mean_ci(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, standard error (ddof 1) and count; :func:`t_quantile` times the error is the half-width."""
    return df.groupBy(*(keys or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def t_quantile(p: float, dof: int) -> float:
    """Quantile of Student's t by bisection on the regularised incomplete beta function."""

    def beta(x: float, a: float, b: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
        f, c, d = 1.0, 1.0, 0.0
        for i in range(400):
            m = i // 2
            if i == 0:
                num = 1.0
            elif i % 2 == 0:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
            if abs(1 - c * d) < 1e-12:
                break
        return front * (f - 1)

    def cdf(t: float) -> float:
        tail = beta(dof / (dof + t * t), dof / 2, 0.5) / 2
        return 1 - tail if t > 0 else tail

    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def rouge_n(pairs: DataFrame, key: str, ref: Column, pred: Column, n: int) -> DataFrame:
    """n-gram precision, recall and F1 of two word arrays per row (no stemming)."""
    a = pairs.select(key, F.explode(ngrams(ref, n)).alias("g"))
    b = pairs.select(key, F.explode(ngrams(pred, n)).alias("g"))
    sized = pairs.select(key).join(bag_overlap(a, b, [key], "g"), key, "left").fillna(0, ["overlap", "n_ref", "n_pred"])
    return sized.select("*", *[c.alias(k) for k, c in prf(F.col("overlap"), F.col("n_ref"), F.col("n_pred")).items() if k != "iou"])


def rouge_n_local(pairs: DataFrame, key: str, ref: Column, pred: Column, n: int) -> DataFrame:
    """:func:`rouge_n` without a shuffle, a result per row whatever its key: whole texts are counted where they stand."""

    def run(batches):
        grams = lambda words: Counter(zip(*(words[i:] for i in range(n)), strict=False))
        for batch in batches:
            out = []
            for i in range(batch.num_rows):  # words of one row at a time
                words = (batch.column(c)[i].values for c in (1, 2))
                a, b = (grams(w.to_numpy(zero_copy_only=False).tolist() if w is not None else []) for w in words)
                out.append((sum(min(c, b[g]) for g, c in a.items()), a.total(), b.total()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[j] for x in out], pa.int64()) for j in range(3)]], [key, "overlap", "n_ref", "n_pred"])

    kind = pairs.schema[key].dataType.simpleString()
    sized = pairs.select(key, ref.alias("r"), pred.alias("p")).mapInArrow(run, f"{key} {kind}, overlap long, n_ref long, n_pred long")
    return sized.select("*", *[c.alias(k) for k, c in prf(F.col("overlap"), F.col("n_ref"), F.col("n_pred")).items() if k != "iou"])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, by the row-wise recurrence."""
    zero = F.transform(b, lambda _: F.lit(0))
    start = lambda: F.struct(F.lit(0).alias("diag"), F.array().cast("array<int>").alias("row"))

    def line(row: Column, x: Column) -> Column:
        cell = lambda s, y, old, i: F.when(x == y, s["diag"] + 1).otherwise(F.greatest(old, F.coalesce(F.get(s["row"], i - 1), F.lit(0))))
        step = lambda s, e: F.struct(e["old"].alias("diag"), F.concat(s["row"], F.array(cell(s, e["y"], e["old"], F.size(s["row"])))).alias("row"))
        return F.aggregate(F.zip_with(b, row, lambda y, old: F.struct(y.alias("y"), old.alias("old"))), start(), step, lambda s: s["row"])

    return F.coalesce(F.array_max(F.aggregate(a, zero, line)), F.lit(0))
