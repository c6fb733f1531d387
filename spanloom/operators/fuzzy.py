"""Fuzzy grounding: token-level Levenshtein search of spans in documents.

With at most k edits, one of k + 1 pieces of the span's tokens stands unchanged
in the document. Pieces join the documents' token runs of the same length by
hash; around each such seed the window that can hold a match is verified by
dynamic programming, thousands of (span, window) pairs at a time in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize
from .spans import token_arrays


def closest(needle: list[str], hay: list[str], most: int) -> tuple[int, int, int] | None:
    """``(distance, start, end)`` of the best token run within ``most`` edits: least distance, then first end, then longest."""
    m = len(needle)
    row = [(j, 0) for j in range(m + 1)]  # (cost, start) by needle prefix
    best = None
    for i, word in enumerate(hay):
        diagonal, row[0] = row[0], (0, i + 1)
        for j in range(1, m + 1):
            keep = row[j]
            row[j] = min((diagonal[0] + (needle[j - 1] != word), diagonal[1]), (keep[0] + 1, keep[1]), (row[j - 1][0] + 1, row[j - 1][1]))
            diagonal = keep
        cost, start = row[m]
        if cost <= most and start <= i and (best is None or (cost, i + 1, start) < best):
            best = (cost, i + 1, start)
    return (best[0], best[2], best[1]) if best else None


def closest_of_each(needles: list[list[str]], hays: list[list[str]], most: list[int], rows: int = 2048) -> list[tuple[int, int, int] | None]:
    """:func:`closest` for many pairs at once: each step of the table is one array operation over ``rows`` pairs.

    Cost and start are one number, so the lesser of two entries is the lesser number. Pairs go by size, so little is padded.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(needles)
    order = sorted(range(len(needles)), key=lambda r: (len(needles[r]), len(hays[r])))
    for lo in range(0, len(order), rows):
        part = order[lo : lo + rows]
        codes: dict[str, int] = {}
        m = np.array([len(needles[r]) for r in part])
        n = np.array([len(hays[r]) for r in part])
        needle, hay = np.full((len(part), max(1, m.max())), -1), np.full((len(part), max(1, n.max())), -2)
        for k, r in enumerate(part):
            needle[k, : m[k]] = [codes.setdefault(w, len(codes)) for w in needles[r]]
            hay[k, : n[k]] = [codes.setdefault(w, len(codes)) for w in hays[r]]
        limit, every, far = np.array([most[r] for r in part]), np.arange(len(part)), 1 << 30
        old = np.tile(np.arange(needle.shape[1] + 1, dtype=np.int64) * far, (len(part), 1))
        best, end = np.full(len(part), np.iinfo(np.int64).max), np.zeros(len(part), dtype=np.int64)
        for i in range(hay.shape[1]):
            new = np.empty_like(old)
            new[:, 0] = i + 1
            for j in range(1, old.shape[1]):
                new[:, j] = np.minimum(old[:, j - 1] + (needle[:, j - 1] != hay[:, i]) * far, np.minimum(old[:, j], new[:, j - 1]) + far)
            old = new
            last = new[every, m]
            # A lower cost wins, then the first end, so a later end needs a lower cost.
            better = (last // far <= limit) & (last % far <= i) & (i < n) & (last // far < best // far)
            best, end = np.where(better, last, best), np.where(better, i + 1, end)
        for k, r in enumerate(part):
            if end[k]:
                out[r] = (int(best[k] // far), int(best[k] % far), int(end[k]))
    return out


def nearest(spans: list[str], text: str, share: float = 0.15, most: int = 10, windows: int = 4096) -> list[tuple[int, int, int] | None]:
    """``(distance, start, end)`` of each span's best match in one text, both normalised: what :func:`fuzzy_match` finds there.

    For tasks that hold a text beside its spans: the text's runs stay in the task, and ``windows`` windows are verified at a time.
    """
    from .ranges import token_bounds

    codes: dict[str, int] = {}
    code = lambda t, s, e: [codes.setdefault(t[a:b], len(codes)) for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    starts, ends = token_bounds(text)
    hay = code(text, starts, ends)
    needles, limit = {}, {}
    pieces: dict[int, list[tuple[int, int]]] = {}
    for j, span in enumerate(spans):
        needle = code(span, *token_bounds(span))
        k = min(int(len(needle) * share), most)
        if k > 0:
            needles[j], limit[j], width = needle, k, len(needle) // (k + 1)
            pieces.setdefault(width, []).extend((j, i * width) for i in range(k + 1))
    best: list[tuple[int, int, int] | None] = [None] * len(spans)
    weight = np.random.default_rng(0).integers(0, 1 << 63, len(codes), dtype=np.uint64)
    low: dict[int, list[np.ndarray]] = {}
    for width, some in pieces.items():
        if len(hay) < width:
            continue
        factor = [np.uint64(pow(0x9E3779B97F4A7C15, t, 1 << 64)) for t in range(width)]
        w = weight[np.array(hay, dtype=np.int64)]
        run = sum(w[t : len(w) - width + 1 + t] * factor[t] for t in range(width))
        w = weight[np.array([needles[j][off : off + width] for j, off in some], dtype=np.int64)]
        piece = sum(w[:, t] * factor[t] for t in range(width))
        order = np.argsort(run, kind="stable")
        first, last = np.searchsorted(run[order], piece, "left"), np.searchsorted(run[order], piece, "right")
        for x in np.flatnonzero(last > first).tolist():
            j, off = some[x]
            low.setdefault(j, []).append(np.maximum(order[first[x] : last[x]] - off - limit[j], 0))

    def verify(part: list[tuple[int, int]]) -> None:
        found = closest_of_each([needles[j] for j, _ in part], [hay[lo : lo + len(needles[j]) + 2 * limit[j]] for j, lo in part], [limit[j] for j, _ in part])
        for (j, lo), f in zip(part, found, strict=True):
            if f:
                hit = (f[0], int(ends[lo + f[2] - 1]), int(starts[lo + f[1]]))
                best[j] = hit if best[j] is None else min(best[j], hit)

    part: list[tuple[int, int]] = []
    for j, lows in low.items():
        for lo in np.unique(np.concatenate(lows)).tolist():
            part.append((j, lo))
            if len(part) == windows:
                verify(part)
                part = []
    verify(part)
    return [(b[0], b[2], b[1]) if b else None for b in best]


def fuzzy_match(spans: DataFrame, docs: DataFrame, share: float = 0.15, most: int = 10, within: list[str] | None = None, hints: DataFrame | None = None) -> DataFrame:
    """Best match per span: ``(span_id, doc_id, start_pos, end_pos, content, total_count, best_dist)``.

    A span of n tokens may differ in ``min(int(n * share), most)`` tokens; spans
    that may not differ at all match nothing. Best is least distance, then the document
    that ``hints(span_id, doc_id)`` names, then first document, then first end.
    With ``within``, columns of both sides, a span is searched in the documents that agree in them alone.
    Runs of all lengths that pieces have come from one pass over the documents' tokens.
    """
    within = within or []
    form = lambda df, c: df.withColumn("_n", normalize(F.col(c)))
    needles = token_arrays(form(spans, "span").select(F.col("span_id").alias("doc_id"), F.col("_n").alias("text"))).select(F.col("doc_id").alias("span_id"), F.col("words").alias("needle"))
    needles = needles.withColumn("k", F.least(F.floor(F.size("needle") * share), F.lit(most)).cast("int")).where("k > 0")
    needles = needles.withColumn("width", F.expr("cast(size(needle) div (k + 1) as int)")).where("width > 0")
    if within:
        needles = needles.join(spans.select("span_id", *within), "span_id")
    seeds = needles.select("span_id", *within, "width", F.explode(F.expr("transform(sequence(0, k), i -> named_struct('off', i * width, 'h', xxhash64(array_join(slice(needle, i * width + 1, width), ' '))))")).alias("s"))
    seeds = seeds.select("span_id", *within, "width", "s.off", "s.h")
    # Documents are cut into arrays where they stand.
    packed = token_arrays(form(docs, "text").select("doc_id", F.col("_n").alias("text")))
    if within:
        packed = packed.join(docs.select("doc_id", *within), "doc_id")
    # The few lengths in use are a one-row table, or one row for each value of ``within``.
    widths = seeds.groupBy(*within).agg(F.collect_set("width").alias("widths"))
    runs = packed.join(widths, within) if within else packed.crossJoin(F.broadcast(widths))
    runs = runs.select("doc_id", *within, "words", F.explode("widths").alias("width")).where("size(words) >= width")
    runs = runs.select("doc_id", *within, "width", F.posexplode(F.expr("transform(sequence(0, size(words) - width), i -> xxhash64(array_join(slice(words, i + 1, width), ' ')))")).alias("at", "h"))
    near = seeds.join(runs, ["h", "width", *within]).drop(*within).join(needles.select("span_id", "needle", "k"), "span_id")
    near = near.select("span_id", "doc_id", "needle", "k", F.greatest(F.lit(0), F.col("at") - F.col("off") - F.col("k")).alias("lo"), (F.size("needle") + 2 * F.col("k")).alias("room")).distinct()
    windows = near.join(packed, "doc_id").select("span_id", "doc_id", "needle", "k", "lo", *[F.expr(f"slice({c}, lo + 1, room)").alias(c) for c in ("words", "starts", "ends")])

    def verify(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = closest_of_each([r["needle"] for r in rows], [r["words"] for r in rows], [r["k"] for r in rows])
            out = [(r["starts"][f[1]], r["ends"][f[2] - 1], f[0]) if f else (None, None, None) for r, f in zip(rows, found, strict=True)]
            cols = [batch.column(0), batch.column(1)] + [pa.array([o[j] for o in out], pa.int32()) for j in range(3)]
            yield pa.RecordBatch.from_arrays(cols, ["span_id", "doc_id", "start_pos", "end_pos", "best_dist"])

    schema = f"span_id {spans.schema['span_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, start_pos int, end_pos int, best_dist int"
    hits = windows.mapInArrow(verify, schema).where("start_pos is not null").distinct()
    # Overlapping hits of one document are one match, the closest.
    near_by = Window.partitionBy("span_id", "doc_id").orderBy("start_pos", "end_pos")
    apart = hits.withColumn("_new", (F.col("start_pos") >= F.coalesce(F.max("end_pos").over(near_by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    far = F.lit(0).alias("far")
    if hints is not None:
        apart = apart.join(hints.select("span_id", F.col("doc_id").alias("_hint")), "span_id", "left")
        far = F.when(F.col("doc_id").eqNullSafe(F.col("_hint")), 0).otherwise(1).alias("far")
    counted = apart.groupBy("span_id").agg(F.sum("_new").alias("total_count"), F.min(F.struct("best_dist", far, "doc_id", "end_pos", "start_pos")).alias("m"))
    best = counted.select("span_id", "total_count", "m.best_dist", "m.doc_id", "m.start_pos", "m.end_pos")
    content = F.expr("substr(text, start_pos + 1, end_pos - start_pos)")
    return best.join(docs.select("doc_id", "text"), "doc_id").select("span_id", "doc_id", "start_pos", "end_pos", content.alias("content"), "total_count", "best_dist")
