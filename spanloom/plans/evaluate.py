"""End to end: completions against references, as one lazy plan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.repair import repaired
from ..functions.text import error_share, parse_selection, strip
from ..operators import metrics, ranges
from ..operators.fuzzy import fuzzy_match, nearest
from ..operators.grounding import MODES


def validate(samples: DataFrame, predictions: DataFrame, allow_partial: bool = False) -> None:
    """Raises if prediction ids are null, repeated or unknown, or (unless allowed) if a sample has none."""
    bad = predictions.agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("d")).first()
    if bad["n"] != bad["d"]:
        raise ValueError("prediction ids are null or repeated")
    if predictions.join(samples, "sample_id", "left_anti").limit(1).count():
        raise ValueError("predictions for unknown samples")
    if not allow_partial and samples.join(predictions, "sample_id", "left_anti").limit(1).count():
        raise ValueError("samples without a prediction")


def ground_keyed(wanted: DataFrame, docs: DataFrame, keys: list[str], fuzzy: bool = True) -> DataFrame:
    """Spans of ``wanted(sample_id, *keys, span[, hint])`` grounded in their sample's ``docs(sample_id, doc_id, text)`` only, in one pass.

    The keys of spans and documents hold the sample's id, so samples never mix. Blank
    spans (white space of any kind) are ``whitespace`` before any mode is tried. Where a span stands in several documents,
    the one its ``hint`` names is taken, else the first.
    """
    hinted = "hint" in wanted.columns
    hint = F.col("hint") if hinted else F.lit(None).cast(docs.schema["doc_id"].dataType)
    asked = wanted.select("sample_id", *keys, "span", hint.alias("hint")).withColumn("blank", F.length(strip(F.col("span"))) == 0)
    # A sample's spans come to each of its documents as one list, so a text stands in one row and travels once; both
    # verbatim modes are tried there, and the earlier mode wins, whichever document it hits.
    key = F.struct("sample_id", *keys)
    shapes = [form(F.col("span")).alias(mode) for mode, form in MODES.items()]
    listed = asked.where(~F.col("blank")).groupBy("sample_id").agg(F.collect_list(F.struct(key.alias("k"), "hint", *shapes)).alias("_spans"))
    forms = docs.select("sample_id", "doc_id", *[form(F.col("text")).alias(mode) for mode, form in MODES.items()])

    both = listed.join(forms, "sample_id").select("doc_id", F.col("_spans.k").alias("k"), F.col("_spans.hint").alias("hint"), *[F.col(f"_spans.{m}").alias(f"span_{m}") for m in MODES], *MODES)

    def search(batches):
        """Each span's place by the first mode that has one: where an earlier mode hits in a document, later ones decide nothing there."""
        n = len(MODES)
        for batch in batches:
            rows, items, found, first_item = [], [], [], 0
            for i in range(batch.num_rows):
                wanted = [batch.column(3 + m)[i].as_py() for m in range(n)]
                texts = [batch.column(3 + n + m)[i].as_py() for m in range(n)]
                for j in range(len(wanted[0])):
                    for m in range(n):
                        at = texts[m].find(wanted[m][j]) if texts[m] is not None and wanted[m][j] is not None else -1
                        if at >= 0:
                            rows.append(i)
                            items.append(first_item + j)
                            found.append((m, at, at + len(wanted[m][j])))
                            break
                first_item += len(wanted[0])
            docs_, items = batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64())
            k, hint = (batch.column(c).flatten().take(items) for c in (1, 2))
            numbers = [pa.array([f[c] for f in found], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([k, hint, docs_, *numbers], ["k", "hint", "doc_id", "mode", "start_pos", "end_pos"])

    schema = T.StructType([T.StructField("k", both.schema["k"].dataType.elementType), T.StructField("hint", both.schema["hint"].dataType.elementType), both.schema["doc_id"], *[T.StructField(c, T.IntegerType()) for c in ("mode", "start_pos", "end_pos")]])
    place = F.struct(F.when(F.col("doc_id").eqNullSafe(F.col("hint")), 0).otherwise(1).alias("far"), "doc_id", "start_pos", "end_pos")
    here = both.mapInArrow(search, schema).select("k", *[F.when(F.col("mode") == i, place).alias(m) for i, m in enumerate(MODES)])
    found = here.groupBy("k").agg(*[c for m in MODES for c in (F.min(m).alias(m), F.count(m).alias(f"n_{m}"))])
    first = F.coalesce(*[F.when(F.col(m).isNotNull(), F.struct(F.col(f"{m}.doc_id"), F.col(f"{m}.start_pos"), F.col(f"{m}.end_pos"), F.lit(m).alias("mode"), F.col(f"n_{m}").alias("total_count"))) for m in MODES]).alias("m")
    hits = found.select(first, *[F.col("k")[k].alias(k) for k in ("sample_id", *keys)]).select("sample_id", *keys, "m.doc_id", "m.start_pos", "m.end_pos", "m.mode", "m.total_count")
    if fuzzy:
        left = asked.where(~F.col("blank")).join(hits.select("sample_id", *keys), ["sample_id", *keys], "left_anti").select("sample_id", key.alias("span_id"), "span", "hint")
        own = docs.select("sample_id", F.struct("sample_id", "doc_id").alias("doc_id"), "text")
        hints = left.where("hint is not null").select("span_id", F.struct("sample_id", F.col("hint").alias("doc_id")).alias("doc_id")) if hinted else None
        near = fuzzy_match(left.drop("hint"), own, within=["sample_id"], hints=hints)
        near = near.select("span_id.sample_id", *[f"span_id.{k}" for k in keys], "doc_id.doc_id", "start_pos", "end_pos", F.lit("fuzzy_match").alias("mode"), "total_count")
        hits = hits.unionByName(near)
    out = asked.select("sample_id", *keys, "span", "blank").join(hits, ["sample_id", *keys], "left")
    mode = F.when(F.col("mode").isNotNull(), F.col("mode")).when(F.col("blank"), "whitespace").otherwise("hallucination")
    minus = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("sample_id", *keys, "span", minus("doc_id"), minus("start_pos"), minus("end_pos"), mode.alias("mode"))


def ground_predictions(parsed: DataFrame, docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Spans of ``parsed(sample_id, spans)``, told by their place ``span_ord``; see :func:`ground_keyed`."""
    each = parsed.select("sample_id", F.posexplode("spans").alias("span_ord", "span")).where("span is not null")
    return ground_keyed(each, docs, ["span_ord"], fuzzy)


def ground_instructions(maps: DataFrame, docs: DataFrame, keys: list[str] | None = None, fuzzy: bool = True) -> DataFrame:
    """Spans of ``maps(sample_id, *keys, selections)`` with ``selections map<instruction, array<struct<span, hint>>>`` or ``array<span>``.

    ``(sample_id, *keys, instruction, span_ord, span, doc_id, start_pos, end_pos, mode)``; null spans count for nothing.
    """
    keys = keys or []
    each = maps.select("sample_id", *keys, F.explode("selections").alias("instruction", "_s")).select("sample_id", *keys, "instruction", F.posexplode("_s").alias("span_ord", "_x"))
    parts = ["_x.span", "_x.hint"] if "struct" in each.schema["_x"].dataType.simpleString() else [F.col("_x").alias("span")]
    wanted = each.select("sample_id", *keys, "instruction", "span_ord", *parts).where("span is not null")
    return ground_keyed(wanted, docs, [*keys, "instruction", "span_ord"], fuzzy)


def score_predictions(docs: DataFrame, references: DataFrame, parsed: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Token scores of each sample's spans against each of its reference groups, as ``ranges.score_groups`` tells them.

    Spans ``parsed(sample_id, spans)`` and references come to each of their sample's documents, so a text travels once; its
    spans are found, searched for near matches and cut into ranges of tokens there. Only numbers go on: a sample's documents
    decide together where a span stands, by mode, distance and document, as in :func:`ground_keyed`.
    """
    told = parsed.select("sample_id", F.transform("spans", lambda s: F.when(s.rlike(r"(?U)\S"), s)).alias("spans"))
    listed = references.groupBy("sample_id").agg(F.collect_list(F.struct("group_ord", "doc_id", "start_pos", "end_pos")).alias("refs"))
    both = told.join(listed, "sample_id").join(docs.select("sample_id", "doc_id", "text"), "sample_id", "left")
    normal = MODES["normalized_match"]
    both = both.withColumn("groups", F.sort_array(F.array_distinct("refs.group_ord")))
    number = F.transform("refs", lambda r: (F.array_position("groups", r["group_ord"]) - 1).cast("int")).alias("g")
    both = both.select("sample_id", "doc_id", "groups", "text", normal(F.col("text")).alias("normal"), "spans", F.transform("spans", normal).alias("normals"), number, *[F.col(f"refs.{c}").alias(c) for c in ("start_pos", "end_pos")], F.col("refs.doc_id").alias("at"))
    names = ["item", "level", "lo", "hi", "ref", "ref_lo", "ref_hi"]

    def search(batches):
        """A document's hits as lists of span, level (the mode; near matches by distance after it) and tokens, and its references' ranges."""
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                doc, text, plain, spans, normals, g, start, end, at = (batch.column(c)[i].as_py() for c in (1, *range(3, 11)))
                hits, refs = [], []
                rows.append((hits, refs))
                if text is None:
                    continue
                found: dict[str, tuple[int, int, int] | None] = {}
                missed: dict[str, str] = {}
                for s, n in zip(spans or [], normals or [], strict=True):
                    if s is None or s in found:
                        continue
                    for mode, (hay, needle) in enumerate(((text, s), (plain, n))):
                        if (place := hay.find(needle)) >= 0:
                            found[s] = (mode, place, place + len(needle))
                            break
                    else:
                        found[s], missed[s] = None, n
                if fuzzy and missed:
                    for s, near in zip(missed, nearest(list(missed.values()), plain), strict=True):
                        found[s] = near and (len(MODES) + near[0], near[1], near[2])
                here = [(j, *found[s]) for j, s in enumerate(spans or []) if s is not None and found[s]]
                starts, ends = ranges.token_bounds(text)
                if not len(starts):
                    hits += [(j, level, 0, -1) for j, level, _, _ in here]
                    continue
                if here:
                    lo, hi = ranges.covered(starts, ends, np.array([h[2] for h in here]), np.array([h[3] for h in here]))
                    hits += [(h[0], h[1], a, b) for h, a, b in zip(here, lo.tolist(), hi.tolist(), strict=True)]
                own: dict[int, list[tuple[int, int]]] = {}
                for k, s, e, a in zip(g or [], start or [], end or [], at or [], strict=True):
                    if k is not None and a is not None and a == doc and a >= 0 and s is not None and s >= 0 and e is not None:
                        own.setdefault(k, []).append((s, e))
                for k, places in own.items():
                    lo, hi = ranges.covered(starts, ends, *np.array(places).T)
                    some = lo <= hi
                    refs += [(k, a, b) for a, b in ranges.disjoint(lo[some].tolist(), hi[some].tolist())]
            columns = [pa.array([[x[c] for x in r[side]] for r in rows], pa.list_(pa.int32())) for side, n in ((0, 4), (1, 3)) for c in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], ["sample_id", "doc_id", "groups", *names])

    whole = T.ArrayType(T.IntegerType())
    placed = both.mapInArrow(search, T.StructType([*[T.StructField(c, both.schema[c].dataType) for c in ("sample_id", "doc_id", "groups")], *[T.StructField(c, whole) for c in names]]))
    joined = placed.groupBy("sample_id").agg(F.first("groups").alias("groups"), F.collect_list(F.struct("doc_id", *names)).alias("docs"))

    def score(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                chosen: dict[int, tuple] = {}
                refs: dict[tuple, list[tuple[int, int]]] = {}
                for d in batch.column(2)[i].as_py():
                    doc = d["doc_id"]
                    for item, level, lo, hi in zip(*(d[c] for c in names[:4]), strict=True):
                        rank = (level, doc is not None, 0 if doc is None else doc)
                        if item not in chosen or rank < chosen[item][0]:
                            chosen[item] = (rank, doc, lo, hi)
                    for k, lo, hi in zip(*(d[c] for c in names[4:]), strict=True):
                        refs.setdefault((k, doc), []).append((lo, hi))
                preds: dict = {}
                for _, doc, lo, hi in chosen.values():
                    if doc is not None and doc >= 0 and lo <= hi:
                        preds.setdefault(doc, []).append((lo, hi))
                preds = {doc: ranges.disjoint(*zip(*places, strict=True)) for doc, places in preds.items()}
                n_ref, overlap = [[0] * len(batch.column(1)[i]) for _ in range(2)]
                for (k, doc), places in refs.items():
                    own = ranges.disjoint(*zip(*places, strict=True))
                    n_ref[k] += sum(b - a + 1 for a, b in own)
                    overlap[k] += ranges.shared(own, preds.get(doc, []))
                out.append((n_ref, sum(b - a + 1 for p in preds.values() for a, b in p), overlap))
            columns = [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["sample_id", "groups", "n_ref", "n_pred", "overlap"])

    counts = T.ArrayType(T.LongType())
    scored = joined.mapInArrow(score, T.StructType([*[T.StructField(c, both.schema[c].dataType) for c in ("sample_id", "groups")], T.StructField("n_ref", counts), T.StructField("n_pred", T.LongType()), T.StructField("overlap", counts)]))
    each = scored.select("sample_id", "n_pred", F.explode(F.arrays_zip("groups", "n_ref", "overlap")).alias("x"))
    sized = each.select("sample_id", F.col("x.groups").alias("group_ord"), "x.n_ref", "n_pred", "x.overlap")
    return sized.select("*", *[c.alias(k) for k, c in metrics.prf(F.col("overlap"), F.col("n_ref"), F.col("n_pred")).items()])


def evaluate(docs: DataFrame, references: DataFrame, predictions: DataFrame, fuzzy: bool = True) -> dict[str, DataFrame]:
    """``scores`` (best reference group per sample), ``summary``, ``modes`` and ``errors``.

    ``docs(sample_id, doc_id, text)``, ``references(sample_id, group_ord, doc_id,
    start_pos, end_pos)`` with a row per group even when empty, and
    ``predictions(sample_id, selection)`` with raw completions. An unparsable
    completion counts as an error and scores as an empty prediction.
    """
    read = predictions.select("sample_id", "selection", parse_selection(F.col("selection")).alias("_fast"))
    parsed = read.select("sample_id", repaired(F.col("_fast"), F.col("selection")).alias("spans"))
    grounded = ground_predictions(parsed, docs, fuzzy)
    scores = metrics.best_group(score_predictions(docs, references, parsed, fuzzy))
    modes = grounded.groupBy("mode").agg(F.count("*").alias("n"))
    errors = parsed.agg(F.sum(error_share(F.col("spans"))).alias("errors"), (F.sum(error_share(F.col("spans"))) / F.count("*")).alias("error_ratio"))
    return {"scores": scores, "summary": metrics.summary(scores), "modes": modes, "errors": errors, "grounded": grounded}
