"""The registered queries of the library and their SQL twins.

Three synthetic raters choose lines of each document by arithmetic that both
engines share: rater r takes line i of document d if (i * (r + 2) + d) % 3 = 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import repair
from .functions import text as tx
from .operators import agreement, build, fuzzy, grounding, metrics, ranges, spans, stats
from .plans.evaluate import evaluate
from .sources import cards, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def line_table(docs: DataFrame) -> DataFrame:
    """Lines with their numbers and first positions, told in the task that holds the text."""
    lines = docs.select("doc_id", F.split("text", "\n").alias("_l"))
    placed = F.zip_with("_l", tx.chunk_ends(F.col("_l")), lambda x, e: F.struct(x.alias("line"), e.alias("e")))
    each = lines.select("doc_id", F.size("_l").alias("_n"), F.posexplode(placed).alias("line_no", "x"))
    start = F.col("x.e") - F.length("x.line") - F.when(F.col("line_no") == F.col("_n") - 1, 0).otherwise(1)
    return each.select("doc_id", "line_no", "x.line", start.alias("start_pos"))


def rater_spans(docs: DataFrame) -> DataFrame:
    rows = line_table(docs).where(F.length("line") > 0).withColumn("rater", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    chosen = rows.where("(line_no * (rater + 2) + doc_id) % 3 = 0")
    return chosen.select("doc_id", "rater", "line_no", "start_pos", (F.col("start_pos") + F.length("line")).alias("end_pos"), F.col("line").alias("content"))


def rater_ids(docs: DataFrame) -> DataFrame:
    return spans.covered_tokens(rater_spans(docs), spans.tokenize(docs), ["rater"]).withColumn("sample_id", F.col("doc_id"))


def rater_ranges(docs: DataFrame) -> DataFrame:
    return ranges.token_ranges(rater_spans(docs).drop("content"), docs, ["rater"]).withColumn("sample_id", F.col("doc_id"))


def all_raters(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("sample_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rater"))


P = tx.PIECES
TOK = f"""pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '{P}')) AS t, generate_subscripts(regexp_extract_all(text, '{P}'), 1) AS i FROM documents),
placed AS (SELECT doc_id, i, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM pieces),
tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tok, t AS text, e - length(t) AS start_pos, e AS end_pos FROM placed WHERE NOT regexp_matches(t, '^[\\s\\p{{Z}}]'))"""
LINES = """lines AS (SELECT doc_id, i - 1 AS line_no, l AS line, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(l) - 1 AS start_pos
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
spans AS (SELECT doc_id, r AS rater, line_no, start_pos, start_pos + length(line) AS end_pos, line AS content FROM lines, (VALUES (0), (1), (2)) v(r)
 WHERE length(line) > 0 AND (line_no * (r + 2) + doc_id) % 3 = 0)"""
IDS = f"""{TOK}, {LINES},
near AS (SELECT doc_id, tok, lead(start_pos) OVER w AS nx, lag(end_pos) OVER w AS pv FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok)),
ids AS (SELECT DISTINCT s.doc_id, s.rater, k.tok FROM spans s JOIN near k ON k.doc_id = s.doc_id AND (k.nx > s.start_pos OR k.nx IS NULL) AND (k.pv < s.end_pos OR k.pv IS NULL))"""
PAIRS = f"""{IDS}, sizes AS (SELECT d.doc_id, r AS rater, count(i.tok) AS n FROM documents d CROSS JOIN (VALUES (0), (1), (2)) v(r) LEFT JOIN ids i ON i.doc_id = d.doc_id AND i.rater = r GROUP BY ALL),
hits AS (SELECT x.doc_id, x.rater AS a, y.rater AS b, count(*) AS o FROM ids x JOIN ids y ON x.doc_id = y.doc_id AND x.tok = y.tok GROUP BY ALL),
scored AS (SELECT x.doc_id AS sample_id, x.rater AS a, y.rater AS b, coalesce(o, 0) AS overlap, x.n AS n_a, y.n AS n_b,
 CASE WHEN x.n = 0 AND y.n = 0 THEN 1.0::DOUBLE WHEN coalesce(o, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * o / (x.n + y.n) END AS f1
 FROM sizes x JOIN sizes y ON x.doc_id = y.doc_id LEFT JOIN hits h ON h.doc_id = x.doc_id AND h.a = x.rater AND h.b = y.rater)"""

# ---------------------------------------------------------------- grounding


def _ground_sql(form_s: str, form_t: str, span: str = "b.text") -> str:
    return f"""WITH hits AS (SELECT b.item_id AS span_id, d.doc_id, strpos({form_t}, {form_s}) - 1 AS start_pos, length({form_s}) AS n, substr(d.text, strpos({form_t}, {form_s}), length({form_s})) AS content
 FROM benchmark b JOIN documents d ON contains({form_t}, {form_s}))
SELECT span_id, min(doc_id) AS doc_id, arg_min(start_pos, doc_id) AS start_pos, arg_min(start_pos + n, doc_id) AS end_pos, arg_min(content, doc_id) AS content, count(*) AS total_count FROM hits GROUP BY span_id"""


@query(_ground_sql("b.text", "d.text"))
def ground_exact(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("span_id"), F.col("text").alias("span"))
    return grounding.first_match(grounding.occurrences(items, docs_of(spark, d)))


@query(_ground_sql("regexp_replace(lower(upper(b.text)), '\\s', ' ', 'g')", "regexp_replace(lower(d.text), '\\s', ' ', 'g')"))
def ground_normalized(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("span_id"), F.upper("text").alias("span"))
    return grounding.first_match(grounding.occurrences(items, docs_of(spark, d), tx.normalize))


CASCADE = """WITH spans AS (SELECT item_id AS span_id, CASE item_id % 5 WHEN 1 THEN replace(text, 'e', 'E') WHEN 2 THEN 'zz ' || text WHEN 3 THEN '  ' ELSE text END AS span FROM benchmark),
e AS (SELECT span_id, 'exact_match' AS mode, doc_id, strpos(text, span) - 1 AS start_pos, length(span) AS n, substr(text, strpos(text, span), length(span)) AS content FROM spans JOIN documents ON contains(text, span) WHERE trim(span) <> ''),
m AS (SELECT span_id, 'normalized_match' AS mode, doc_id, strpos(t, s) - 1 AS start_pos, length(s) AS n, substr(text, strpos(t, s), length(s)) AS content
 FROM (SELECT span_id, regexp_replace(lower(span), '\\s', ' ', 'g') AS s FROM spans WHERE trim(span) <> '' AND span_id NOT IN (SELECT span_id FROM e))
 JOIN (SELECT doc_id, text, regexp_replace(lower(text), '\\s', ' ', 'g') AS t FROM documents) ON contains(t, s)),
hit AS (SELECT span_id, mode, min(doc_id) AS doc_id, arg_min(start_pos, doc_id) AS start_pos, arg_min(start_pos + n, doc_id) AS end_pos, arg_min(content, doc_id) AS content, count(*) AS total_count FROM (SELECT * FROM e UNION ALL SELECT * FROM m) GROUP BY span_id, mode),
grounded AS (SELECT * FROM hit UNION ALL SELECT span_id, CASE WHEN trim(span) = '' THEN 'whitespace' ELSE 'hallucination' END, -1, -1, -1, span, 0 FROM spans WHERE span_id NOT IN (SELECT span_id FROM hit))"""


def cascade(spark, d):
    kind = F.col("item_id") % 5
    span = F.when(kind == 1, F.replace("text", F.lit("e"), F.lit("E"))).when(kind == 2, F.concat(F.lit("zz "), "text")).when(kind == 3, F.lit("  ")).otherwise(F.col("text"))
    return grounding.ground(table(spark, d, "benchmark").select(F.col("item_id").alias("span_id"), span.alias("span")), docs_of(spark, d))


@query(CASCADE + " SELECT span_id, mode, doc_id, start_pos, end_pos, content, total_count FROM grounded")
def ground_cascade(spark, d):
    return cascade(spark, d).select("span_id", "mode", "doc_id", "start_pos", "end_pos", "content", "total_count")


@query(CASCADE + " SELECT mode, count(*) AS n FROM grounded GROUP BY mode")
def ground_mode_histogram(spark, d):
    return grounding.mode_histogram(cascade(spark, d))


@query(CASCADE + " SELECT count(*) FILTER (mode = 'hallucination') AS n_hallucinated, count(*) AS n_spans, count(*) FILTER (mode = 'hallucination') / count(*) AS rate FROM grounded")
def hallucination_rate(spark, d):
    return grounding.hallucination_rate(cascade(spark, d))


# ---------------------------------------------------------------- tokens, spans


@query(f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens, sum(start_pos) AS sum_start, sum(end_pos) AS sum_end, sum(tok) AS sum_tok FROM tok GROUP BY doc_id")
def tokenize_offsets(spark, d):
    return spans.tokenize(docs_of(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("start_pos").alias("sum_start"), F.sum("end_pos").alias("sum_end"), F.sum("tok").alias("sum_tok"))


@query("SELECT lang, source, count(*) AS n_docs, sum(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]'))) AS n_tokens FROM documents GROUP BY lang, source")
def token_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(tx.token_count(F.col("text"))).alias("n_tokens"))


@query(f"WITH {IDS} SELECT doc_id, rater, count(*) AS n_tokens, sum(tok) AS sum_tok FROM ids GROUP BY doc_id, rater")
def span_to_tokens(spark, d):
    n = (F.col("hi") - F.col("lo") + 1).cast("long")
    return rater_ranges(docs_of(spark, d)).groupBy("doc_id", "rater").agg(F.sum(n).alias("n_tokens"), F.sum(F.expr("(hi - lo + 1L) * (lo + hi) div 2")).alias("sum_tok"))


ISLANDS = """SELECT {keys}, doc_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT x.*, t.start_pos, t.end_pos, x.tok - row_number() OVER (PARTITION BY {part} ORDER BY x.tok) AS g FROM {ids} x JOIN tok t ON t.doc_id = x.doc_id AND t.tok = x.tok) GROUP BY ALL"""


@query(f"WITH {IDS}, isl AS ({ISLANDS.format(keys='rater, g', part='x.doc_id, x.rater', ids='ids')}) SELECT doc_id, rater, start_pos, end_pos FROM isl")
def tokens_to_spans(spark, d):
    return rater_ranges(docs_of(spark, d)).select("doc_id", "rater", "start_pos", "end_pos")


@query(f"WITH {IDS}, v AS (SELECT doc_id, tok FROM ids GROUP BY doc_id, tok HAVING count(DISTINCT rater) >= 2), isl AS ({ISLANDS.format(keys='g', part='x.doc_id', ids='v')}) SELECT doc_id, start_pos, end_pos FROM isl")
def majority_vote(spark, d):
    docs = docs_of(spark, d)
    return ranges.vote_ranges(rater_ranges(docs), ["doc_id"], 2).select("doc_id", "start_pos", "end_pos")


MERGE = """SELECT doc_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT *, CASE WHEN start_pos > coalesce(max(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS new FROM {src})) GROUP BY doc_id, g"""


@query(f"WITH {LINES}, u AS (SELECT DISTINCT doc_id, start_pos, end_pos FROM spans) " + MERGE.format(src="u"))
def span_union(spark, d):
    return spans.merge_spans(rater_spans(docs_of(spark, d)).select("doc_id", "start_pos", "end_pos").distinct(), ["doc_id"])


@query(f"""WITH {LINES}, wide AS (SELECT doc_id, greatest(start_pos - 7, 0) AS start_pos, end_pos + 5 AS end_pos FROM spans WHERE rater = 1),
common AS (SELECT DISTINCT a.doc_id, greatest(a.start_pos, b.start_pos) AS start_pos, least(a.end_pos, b.end_pos) AS end_pos FROM spans a JOIN wide b ON a.doc_id = b.doc_id AND a.rater = 0 AND greatest(a.start_pos, b.start_pos) < least(a.end_pos, b.end_pos)) """ + MERGE.format(src="common"))
def span_intersect(spark, d):
    s = rater_spans(docs_of(spark, d))
    wide = s.where("rater = 1").select("doc_id", F.greatest(F.col("start_pos") - 7, F.lit(0)).alias("start_pos"), (F.col("end_pos") + 5).alias("end_pos"))
    return spans.intersect_spans(s.where("rater = 0"), wide, ["doc_id"])


@query(f"WITH {LINES} SELECT doc_id, sum(end_pos - start_pos) AS n_chars, sum((end_pos - start_pos) * (start_pos + end_pos - 1) // 2) AS sum_char FROM spans GROUP BY doc_id")
def span_characters(spark, d):
    return spans.characters(rater_spans(docs_of(spark, d)).select("doc_id", "start_pos", "end_pos")).groupBy("doc_id").agg(F.count("*").alias("n_chars"), F.sum("char").alias("sum_char"))


@query("SELECT doc_id, i - 1 AS ord, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY i), 0) AS start_pos, e AS end_pos FROM (SELECT doc_id, i, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - CASE WHEN i = n THEN 1 ELSE 0 END AS e FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents))")
def sentence_boundaries(spark, d):
    lines = docs_of(spark, d).select("doc_id", F.split("text", "\n").alias("l"))
    ends = lines.select("doc_id", tx.chunk_ends(F.col("l")).alias("e"))
    return ends.select("doc_id", F.posexplode(tx.sentence_bounds(F.col("e"))).alias("ord", "b")).select("doc_id", "ord", "b.start_pos", "b.end_pos")


@query(f"""WITH {LINES}, u AS (SELECT DISTINCT doc_id, start_pos, end_pos FROM spans WHERE rater = 0), m AS ({MERGE.format(src='u')}),
gaps AS (SELECT doc_id, coalesce(lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), 0) AS s, start_pos AS e FROM m UNION ALL SELECT d.doc_id, coalesce(max(m.end_pos), 0), length(any_value(d.text)) FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, start_pos, end_pos, true AS marked FROM m UNION ALL SELECT doc_id, s, e, false FROM gaps WHERE e > s""")
def highlights(spark, d):
    docs = docs_of(spark, d)
    return spans.highlights(rater_spans(docs).where("rater = 0"), docs)


@query(f"""WITH {LINES}, h AS (SELECT doc_id, start_pos, start_pos + length(line) AS end_pos, line AS header FROM lines WHERE line_no % 4 = 0),
j AS (SELECT s.doc_id, s.start_pos AS s, s.end_pos AS e, h.start_pos AS hs, h.end_pos AS he, h.header, row_number() OVER (PARTITION BY s.doc_id, s.start_pos, s.end_pos ORDER BY h.start_pos DESC, h.end_pos DESC, h.header DESC) AS r FROM spans s JOIN h ON h.doc_id = s.doc_id AND h.start_pos < s.end_pos WHERE s.rater = 2)
SELECT doc_id, header, s - he AS start_pos, e - he AS end_pos FROM j WHERE r = 1""")
def asof_header(spark, d):
    docs = docs_of(spark, d)
    heads = line_table(docs).where("line_no % 4 = 0").select("doc_id", "start_pos", (F.col("start_pos") + F.length("line")).alias("end_pos"), F.col("line").alias("header"))
    return spans.last_header_before(rater_spans(docs).where("rater = 2"), heads, "doc_id")


@query(f"""WITH {LINES}, a AS (SELECT doc_id, rater, start_pos AS s, end_pos AS e FROM spans), g AS (SELECT x.doc_id, x.rater, x.s, x.e, min(greatest(0, y.s - x.e, x.s - y.e)) AS g FROM a x JOIN a y ON x.doc_id = y.doc_id AND x.rater = y.rater AND (x.s <> y.s OR x.e <> y.e) GROUP BY ALL)
SELECT doc_id, rater, sum(g) AS gap_sum, count(*) AS n_spans FROM g GROUP BY doc_id, rater""")
def span_scatter(spark, d):
    return spans.nearest_gap(rater_spans(docs_of(spark, d)), ["doc_id", "rater"])


@query(f"WITH {LINES} SELECT count(*) AS n_violations FROM spans WHERE (doc_id + line_no) % 5 = 0")
def integrity_violations(spark, d):
    """A fifth of the spans is planted with another content."""
    docs = docs_of(spark, d)
    planted = rater_spans(docs).withColumn("content", F.when(F.expr("(doc_id + line_no) % 5 = 0"), F.concat("content", F.lit("~"))).otherwise(F.col("content")))
    return build.violations(planted, docs).agg(F.count("*").alias("n_violations"))


# ---------------------------------------------------------------- metrics


@query(f"WITH {PAIRS} SELECT sample_id, a, b, overlap, n_a, n_b, f1 FROM scored WHERE a < b")
def pairwise_f1(spark, d):
    docs = docs_of(spark, d)
    return ranges.pair_scores(rater_ranges(docs), all_raters(docs))


def scored_groups(spark, d):
    docs = docs_of(spark, d)
    ids = rater_ranges(docs)
    groups = docs.select(F.col("doc_id").alias("sample_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("group_ord"))
    refs = ids.where("rater < 2").withColumnRenamed("rater", "group_ord")
    return ranges.score_groups(refs, ids.where("rater = 2").select("sample_id", "doc_id", "lo", "hi", "start_pos", "end_pos"), groups)


SCORES = PAIRS + """, g AS (SELECT sample_id, a AS group_ord, n_a AS n_ref, n_b AS n_pred, overlap, f1,
 CASE WHEN n_a = 0 AND n_b = 0 THEN 1.0::DOUBLE WHEN overlap = 0 THEN 0.0::DOUBLE ELSE overlap / n_b END AS precision, CASE WHEN n_a = 0 AND n_b = 0 THEN 1.0::DOUBLE WHEN overlap = 0 THEN 0.0::DOUBLE ELSE overlap / n_a END AS recall,
 CASE WHEN n_a = 0 AND n_b = 0 THEN 1.0::DOUBLE WHEN overlap = 0 THEN 0.0::DOUBLE ELSE overlap / (n_a + n_b - overlap) END AS iou FROM scored WHERE a < 2 AND b = 2),
best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY f1 DESC, group_ord) = 1)"""


@query(f"WITH {SCORES} SELECT sample_id, group_ord, n_ref, n_pred, overlap, precision, recall, f1, iou FROM g")
def score_selection(spark, d):
    return scored_groups(spark, d).select("sample_id", "group_ord", "n_ref", "n_pred", "overlap", "precision", "recall", "f1", "iou")


@query(f"WITH {SCORES} SELECT sample_id, group_ord, overlap, n_ref, n_pred, f1, iou FROM best")
def score_best_reference(spark, d):
    return metrics.best_group(scored_groups(spark, d)).select("sample_id", "group_ord", "overlap", "n_ref", "n_pred", "f1", "iou")


@query(f"WITH {SCORES} SELECT count(*) AS n, round(avg(f1), 9) AS f1, round(avg(iou), 9) AS iou, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall FROM best")
def eval_summary(spark, d):
    out = metrics.summary(metrics.best_group(scored_groups(spark, d)))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("f1", "iou", "precision", "recall")])


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars) / sqrt(count(*)), 6) AS sem FROM documents GROUP BY lang")
def mean_ci(spark, d):
    return metrics.mean_ci(table(spark, d, "documents"), "n_chars", ["lang"]).select("lang", "n", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


def _rouge_sql(n: int) -> str:
    gram = "list_transform(range(1, len({w}) - %d), lambda i: array_to_string(list_slice({w}, i, i + %d), ' '))" % (n - 2, n - 1)
    return f"""WITH p AS (SELECT doc_id, string_split(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: length(x) > 0 AND ((i - 1) * 2 + doc_id) % 3 = 0), ' '), ' ') AS r, string_split(replace(text, chr(10), ' '), ' ') AS q FROM documents),
a AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({gram.format(w='r')}) AS g FROM p) GROUP BY ALL), b AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest({gram.format(w='q')}) AS g FROM p) GROUP BY ALL),
o AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) AS overlap, sum(coalesce(a.c, 0)) AS n_ref, sum(coalesce(b.c, 0)) AS n_pred FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.g = b.g GROUP BY 1)
SELECT p.doc_id, coalesce(overlap, 0)::BIGINT AS overlap, coalesce(n_ref, 0)::BIGINT AS n_ref, coalesce(n_pred, 0)::BIGINT AS n_pred,
 CASE WHEN coalesce(n_ref, 0) = 0 AND coalesce(n_pred, 0) = 0 THEN 1.0::DOUBLE WHEN overlap = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * overlap / (n_ref + n_pred) END AS f1 FROM p LEFT JOIN o ON o.doc_id = p.doc_id"""


def _rouge(spark, d, n):
    """The lines rater 0 chooses as reference against the whole text."""
    chosen = F.filter(F.split("text", "\n"), lambda x, i: (F.length(x) > 0) & ((i * 2 + F.col("doc_id")) % 3 == 0))
    pairs = docs_of(spark, d).select("doc_id", F.split(F.array_join(chosen, " "), " ").alias("r"), F.split("text", " |\n").alias("q"))
    return metrics.rouge_n_local(pairs, "doc_id", F.col("r"), F.col("q"), n).select("doc_id", "overlap", "n_ref", "n_pred", "f1")


@query(_rouge_sql(1))
def rouge1(spark, d):
    return _rouge(spark, d, 1)


@query(_rouge_sql(2))
def rouge2(spark, d):
    return _rouge(spark, d, 2)


# ---------------------------------------------------------------- agreement


@query(f"WITH {PAIRS} SELECT sample_id, round(avg(f1), 9) AS agreement FROM scored WHERE a < b GROUP BY sample_id")
def ila_by_sample(spark, d):
    docs = docs_of(spark, d)
    return agreement.sample_agreement(ranges.pair_scores(rater_ranges(docs), all_raters(docs))).select("sample_id", F.round("agreement", 9).alias("agreement"))


@query(f"""WITH {PAIRS}, p AS (SELECT * FROM scored WHERE a < b), l AS (SELECT f1, 'all' AS level, '' AS name FROM p UNION ALL SELECT f1, 'rater', a::VARCHAR FROM p UNION ALL SELECT f1, 'rater', b::VARCHAR FROM p UNION ALL SELECT f1, 'pair', a || '-' || b FROM p)
SELECT level, name, round(avg(f1), 9) AS f1, count(*) AS n FROM l GROUP BY level, name""")
def ila_report(spark, d):
    docs = docs_of(spark, d)
    return agreement.agreement_report(ranges.pair_scores(rater_ranges(docs), all_raters(docs))).select("level", "name", F.round("f1", 9).alias("f1"), "n")


@query(f"WITH {PAIRS}, m AS (SELECT sample_id, a, round(avg(f1), 9) AS f1 FROM scored GROUP BY ALL) SELECT sample_id, a AS rater, f1 FROM m QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY f1 DESC, a) = 1")
def medoid_selection(spark, d):
    docs = docs_of(spark, d)
    pairs = ranges.pair_scores(rater_ranges(docs), all_raters(docs), with_self=True, ordered=True)
    return agreement.medoid(pairs.withColumn("f1", F.col("f1"))).select("sample_id", "rater", F.round("f1", 9).alias("f1"))


@query(f"WITH {PAIRS} SELECT a, round(avg(f1) FILTER (b = 0), 9) AS r0, round(avg(f1) FILTER (b = 1), 9) AS r1, round(avg(f1) FILTER (b = 2), 9) AS r2 FROM scored GROUP BY a")
def agreement_matrix(spark, d):
    docs = docs_of(spark, d)
    pairs = ranges.pair_scores(rater_ranges(docs), all_raters(docs), with_self=True, ordered=True)
    return pairs.groupBy("a").pivot("b", [0, 1, 2]).agg(F.round(F.avg("f1"), 9)).toDF("a", "r0", "r1", "r2")


def ratings(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select("doc_id", ((F.col("quality") * 2 + F.col("n_chars")) % 5).cast("int").alias("x"), ((F.col("quality") * 2 + F.col("n_chars") + F.col("toxic") + F.col("doc_id") % 2) % 5).cast("int").alias("y"))


def _kappa_sql(w: str) -> str:
    return f"""WITH r AS (SELECT (quality * 2 + n_chars) % 5 AS i, (quality * 2 + n_chars + toxic + l.doc_id % 2) % 5 AS j FROM labels l JOIN documents d ON d.doc_id = l.doc_id), c AS (SELECT i, j, count(*) AS n FROM r GROUP BY ALL), a AS (SELECT i, count(*) AS r FROM r GROUP BY i), b AS (SELECT j, count(*) AS c FROM r GROUP BY j),
g AS (SELECT a.i, b.j, a.r, b.c, coalesce(c.n, 0) AS n, abs(a.i - b.j) AS d FROM a CROSS JOIN b LEFT JOIN c ON c.i = a.i AND c.j = b.j), s AS (SELECT sum(n) AS n, sum({w} * n) AS o, sum({w} * r * c) AS e FROM g)
SELECT o::BIGINT AS observed, e::BIGINT AS expected, CASE WHEN e > 0 THEN 1 - (o * n)::DOUBLE / e END AS kappa FROM s"""


for _name, _w, _weights, _close in (("none", "(d > 0)::INT", None, False), ("linear", "d", "linear", False), ("quadratic", "d * d", "quadratic", False), ("close", "greatest(0, d - 1)", "linear", True)):

    def _run(spark, d, weights=_weights, close=_close):
        return agreement.kappa(ratings(spark, d), "x", "y", 5, weights, close)

    QUERIES[f"cohen_kappa_{_name}"] = _run
    ORACLE[f"cohen_kappa_{_name}"] = _kappa_sql(_w)


@query("SELECT g, count(*) AS n FROM (SELECT CASE WHEN r IN (1, 2) THEN 1 WHEN r = 3 THEN 2 WHEN r IN (4, 5) THEN 3 END AS g FROM (SELECT l_linenumber AS r FROM lineitem)) GROUP BY g")
def rating_recode_hist(spark, d):
    return table(spark, d, "lineitem").select(agreement.recode(F.col("l_linenumber")).alias("g")).groupBy("g").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- parsing and cleaning


#: Articles beside any sign that is no letter or digit; the pattern eats what stands between two of them, so it runs twice.
_NO_ARTICLE = r"regexp_replace({0}, '(^|[^\p{{L}}\p{{N}}])(?:a|an|the)([^\p{{L}}\p{{N}}]|$)', '\1 \2', 'g')"
ANSWER_OF = lambda c: f"array_to_string(list_filter(regexp_split_to_array({_NO_ARTICLE.format(_NO_ARTICLE.format(rf"regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', '', 'g')"))}, '\\s+'), lambda w: w <> ''), ' ')"
ANSWER = f"SELECT doc_id, {ANSWER_OF('text')} AS answer FROM documents"


@query(ANSWER)
def normalize_answer(spark, d):
    return docs_of(spark, d).select("doc_id", tx.normalize_answer(F.col("text")).alias("answer"))


def completions(spark, d):
    """Raw completions made of all lines of a document: a JSON array, plain, prefixed, fenced, or cut off."""
    lines = F.to_json(F.split("text", "\n"))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("Selected Content:\n\n"), lines)).when(kind == 1, F.concat(F.lit("```json\n"), lines, F.lit("\n```"))).when(kind == 2, F.lit("[ Invalid")).otherwise(lines)
    return docs_of(spark, d).select("doc_id", raw.alias("raw"))


PARSED = """SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN NULL ELSE string_split(text, chr(10)) END AS p FROM documents"""


@query(f"WITH p AS ({PARSED}) SELECT doc_id, len(p) AS n_spans, md5(array_to_string(p, '|')) AS digest FROM p")
def parse_selections(spark, d):
    p = completions(spark, d).select("doc_id", tx.parse_selection(F.col("raw")).alias("p"))
    return p.select("doc_id", F.when(F.col("p").isNotNull(), F.size("p")).cast("long").alias("n_spans"), F.md5(F.array_join("p", "|")).alias("digest"))


@query(f"WITH p AS ({PARSED}) SELECT count(*) AS n, sum(CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS errors, sum(CASE WHEN p IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / count(*) AS ratio FROM p")
def parse_error_ratio(spark, d):
    p = completions(spark, d).select(tx.error_share(tx.parse_selection(F.col("raw"))).alias("e"))
    return p.agg(F.count("*").alias("n"), F.sum("e").alias("errors"), (F.sum("e") / F.count("*")).alias("ratio"))


STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {STRIPPED.format('text')} AS rest FROM documents")
def strip_preamble(spark, d):
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "assistant\n\nSelected Content: ").otherwise("Selected Content:\n"), F.col("text"), F.lit(" \n"))
    return docs_of(spark, d).select("doc_id", tx.remove_preamble(raw).alias("rest"))


@query(f"SELECT doc_id, {STRIPPED.format('text')} AS inside FROM documents")
def crop_fence(spark, d):
    raw = F.concat(F.lit("Here it is:\n```text\n"), F.col("text"), F.lit("\n```"))
    return docs_of(spark, d).select("doc_id", tx.crop_fence(raw).alias("inside"))


def _clean_sql() -> str:
    inside = lambda c, m: f"SELECT doc_id, CASE WHEN starts_with(c, '{m}') AND ends_with(c, '{m}') THEN {STRIPPED.format(f'substr(c, {len(m) + 1}, greatest(length(c) - {2 * len(m)}, 0))')} ELSE c END AS c FROM ({c})"
    tail = lambda c, test: f"SELECT doc_id, CASE WHEN {test} THEN {STRIPPED.format('substr(c, 1, length(c) - 1)')} ELSE c END AS c FROM ({c})"
    raw = "'```' || chr(10) || '\"' || text || '\".' || chr(10) || '```'"
    c = f"SELECT doc_id, {STRIPPED.format(raw)} AS c FROM documents"
    c = tail(inside(c, "```"), "ends_with(c, ':') OR ends_with(c, '.')")
    c = inside(c, '"')
    c = f"SELECT doc_id, CASE WHEN starts_with(c, chr(39)) AND ends_with(c, chr(39)) THEN {STRIPPED.format('substr(c, 2, greatest(length(c) - 2, 0))')} ELSE c END AS c FROM ({c})"
    return f"SELECT doc_id, c AS cleaned FROM ({inside(tail(c, "ends_with(c, '.')"), '```')})"


@query(_clean_sql())
def clean_text(spark, d):
    return docs_of(spark, d).select("doc_id", tx.clean_text(F.concat(F.lit('```\n"'), F.col("text"), F.lit('".\n```'))).alias("cleaned"))


@query("SELECT doc_id, lang AS dataset, 'test' AS split, source || '+x ' || doc_id AS id FROM documents")
def parse_guid(spark, d):
    guid = F.concat("lang", F.lit(".test."), "source", F.lit("+x%20"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", tx.parse_guid(guid).alias("g")).select("doc_id", "g.dataset", "g.split", "g.id")


@query("SELECT doc_id, i AS ord, doc_id + i AS start_pos, doc_id + i + 5 AS end_pos FROM documents, (VALUES (0), (1), (2)) v(i)")
def parse_offsets(spark, d):
    text = F.expr("array_join(transform(sequence(0, 2), i -> concat(doc_id + i, ',', doc_id + i + 5)), ';')")
    return docs_of(spark, d).select("doc_id", F.posexplode(tx.parse_offsets(text)).alias("ord", "o")).select("doc_id", "ord", "o.start_pos", "o.end_pos")


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@x.org|' || c_mktsegment || '@y.org' AS addresses FROM customer")
def split_addresses(spark, d):
    head = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@x.org, "), F.col("c_mktsegment"), F.lit("@y.org,, "), F.col("c_mktsegment"), F.lit("@y.org"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(tx.split_addresses(head), "|").alias("addresses"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'read the code of ' ELSE 'read the text of ' END || lang AS wording FROM documents")
def guideline_wording(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.choose_wording(F.concat(F.lit("read the {code|text} of "), "lang"), F.col("source") == "src1").alias("wording"))


@query("SELECT n_name, 'test-' || r_name || '-' || n_name || '_v1.jsonl.gz' AS file FROM nation JOIN region ON r_regionkey = n_regionkey")
def prediction_files(spark, d):
    both = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.select("n_name", tx.prediction_file(F.concat("n_name", F.lit("/v1")), F.col("r_name")).alias("file"))


# ---------------------------------------------------------------- dataset building


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(spark, d):
    return build.keep_first(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), ["text"], "doc_id").select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents e WHERE doc_id % 3 = 0 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 <> 0)")
def decontaminate_splits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return build.drop_seen(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0"), ["text"]).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) <= 25")
def stratified_sample(spark, d):
    return build.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 25)


@query("SELECT doc_id, lang, CASE WHEN p < floor(n * 0.7) THEN 'train' WHEN p < floor(n * 0.7) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def stratified_split(spark, d):
    return build.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 BETWEEN 50 AND 69 AS is_negative FROM documents")
def negative_flags(spark, d):
    return build.flag_negatives(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 20)


@query("SELECT source, count(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, sum(n_chars)::BIGINT AS n_chars_sum FROM documents GROUP BY source")
def cluster_docs(spark, d):
    out = build.cluster(table(spark, d, "documents"), "source", ["lang"], ["n_chars"])
    return out.select("source", "n", F.array_join("langs", ",").alias("langs"), "n_chars_sum")


@query("SELECT doc_id, 'Find ' || lang || ' text from ' || source || '.' || chr(10) || chr(10) || 'Document #0:' || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10) AS prompt FROM documents")
def prompt_format(spark, d):
    rows = table(spark, d, "documents")
    doc = F.array(F.struct(F.lit(0).alias("id"), F.col("text")))
    out = build.prompts(rows, "Find {lang} text from {source}.", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), doc, "You select text.")
    return out.select("doc_id", F.get("conversations", F.lit(1))["content"].alias("prompt"))


@query("""WITH few AS (SELECT item_id AS e, row_number() OVER (ORDER BY md5(item_id || ':42'), item_id) AS o FROM benchmark QUALIFY o <= 4) SELECT item_id, array_to_string(list_slice(list(e ORDER BY o), 1, 3), ',') AS examples FROM benchmark, few WHERE e <> item_id GROUP BY item_id""")
def icl_examples(spark, d):
    items = table(spark, d, "benchmark").select("item_id")
    return build.in_context_examples(items, items, "item_id", 3).select("item_id", F.array_join("examples", ",").alias("examples"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n, sum(length(content)) AS n_chars, sum(start_pos) AS sum_start FROM spans WHERE rater = 0 GROUP BY doc_id")
def answer_json(spark, d):
    chosen = rater_spans(docs_of(spark, d)).where("rater = 0")
    nested = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("doc_id", "start_pos", "end_pos", "content")).alias("s"))
    back = tx.parse_selection(build.answer(F.col("s")))
    sums = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["start_pos"])
    return nested.select("doc_id", F.size(back).cast("long").alias("n"), F.aggregate(back, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"), sums.alias("sum_start"))


@query("SELECT doc_id, doc_id % 4 <> 1 AS ok FROM documents")
def digest_integrity(spark, d):
    """Texts restored by id against salted digests; one in four is restored with a change."""
    rows = docs_of(spark, d)
    known = rows.select("doc_id", F.sha2(F.concat(F.lit("salt"), "text"), 512).alias("digest"))
    restored = rows.select("doc_id", F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text"))
    return build.restored_ok(restored, known, "doc_id", "salt").select("doc_id", "ok")


@query("SELECT conv_id, sum(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s\\p{Z}]')) + 3) + 3 AS tokens FROM conversations GROUP BY conv_id")
def conversation_cost(spark, d):
    return build.token_cost(table(spark, d, "conversations"), "conv_id", tx.token_count(F.col("text")))


@query(f"""WITH {LINES}, s AS (SELECT doc_id, rater, count(*) AS n_sel, sum(end_pos - start_pos) AS sel_chars, sum((end_pos - start_pos) * (end_pos - start_pos)) AS sq FROM spans GROUP BY ALL)
SELECT lang, rater, count(*) AS n_samples, sum(n_sel)::BIGINT AS n_sel, round(avg(sel_chars::DOUBLE / n_chars), 9) AS compression, round(avg(sq::DOUBLE / sel_chars), 6) AS density, median(n_sel) AS median_sel FROM s JOIN documents d ON d.doc_id = s.doc_id GROUP BY lang, rater""")
def dataset_stats(spark, d):
    s = rater_spans(docs_of(spark, d)).withColumn("w", (F.col("end_pos") - F.col("start_pos")).cast("long")).groupBy("doc_id", "rater").agg(F.count("*").alias("n_sel"), F.sum("w").alias("sel_chars"), F.sum(F.col("w") * F.col("w")).alias("sq"))
    both = s.join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return both.groupBy("lang", "rater").agg(F.count("*").alias("n_samples"), F.sum("n_sel").alias("n_sel"), F.round(F.avg(F.col("sel_chars") / F.col("n_chars")), 9).alias("compression"), F.round(F.avg(F.col("sq") / F.col("sel_chars")), 6).alias("density"), F.median("n_sel").alias("median_sel"))


# ---------------------------------------------------------------- statistics


@query("SELECT round(avg(m), 6) AS macro, count(*) AS n_groups FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type)")
def macro_average(spark, d):
    return stats.macro_average(table(spark, d, "events"), "value", "event_type").select(F.round("macro", 6).alias("macro"), "n_groups")


#: The chain of integer operations behind random picks, from the number {0} to one below {1}.
CHAIN = "(({0} * {0} + 1226874159 * {0} + 1343714438) % 2147483647)"


def picked(start: str, size: str, rows: str, kept: str) -> str:
    """``kept`` and ``pick`` of each of ``rows``."""
    return f"SELECT {kept}, x2 * {size} // 2147483647 AS pick FROM (SELECT *, {CHAIN.format('x1')} AS x2 FROM (SELECT *, {CHAIN.format('x0')} AS x1 FROM (SELECT *, ({start}) % 2147483647 AS x0 FROM {rows})))"


def draws_sql(values: str, group: str, draws: int) -> str:
    """The macro average of each draw from ``values(g, id, v)``, whose groups have one cell each."""
    return f"""v AS ({values}), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id, v) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, ('0x' || substr(md5({group}), 1, 7))::BIGINT AS code FROM v),
q AS (SELECT g, code, n, pos AS place, b AS draw FROM p, range({draws}) t(b)),
k AS ({picked('42 * 48271 + code + draw * 1583458089 + place * 784588716', 'n', 'q', 'g, draw')}),
m AS (SELECT k.g, draw, sum(v)::DOUBLE / count(*) AS m FROM k JOIN p ON p.g = k.g AND p.pos = k.pick GROUP BY ALL)"""


QUALITY = "SELECT lang AS g, doc_id AS id, quality::DOUBLE AS v FROM labels JOIN documents USING (doc_id)"


@query(f"""WITH {draws_sql(QUALITY, 'g', 1000)}, a AS (SELECT draw, avg(m) AS m FROM m GROUP BY draw)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS draws FROM a""")
def bootstrap_ci(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", F.col("doc_id").alias("id"), "quality")
    return stats.bootstrap_macro(rows, "quality", "lang", 1000).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "draws")


@query(f"""WITH p AS (SELECT doc_id AS id, (quality - toxic)::DOUBLE AS d, ('0x' || substr(md5(doc_id::VARCHAR), 1, 7))::BIGINT AS code FROM labels),
q AS (SELECT d, code, b AS draw FROM p, range(1000) t(b)), k AS ({picked('42 * 48271 + code + draw * 1583458089', '2147483647', 'q', 'd, draw')}),
s AS (SELECT draw, sum(CASE WHEN pick % 2 = 0 THEN d ELSE -d END) AS s FROM k GROUP BY draw), o AS (SELECT sum(d) AS o FROM p)
SELECT any_value(o) AS observed, count(*) FILTER (s >= o) AS n_as_large, CASE WHEN any_value(o) > 0 THEN (1 + count(*) FILTER (s >= o)) / (1 + count(*)) END AS p FROM s, o""")
def paired_permutation(spark, d):
    return stats.permutation_test(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality"), "toxic", "quality", 1000)


PAIRED = "SELECT o_orderpriority AS k, (o_orderkey % 7)::INT - 3 AS d FROM orders"


@query(f"""WITH p AS ({PAIRED}), r AS (SELECT k, d, rank() OVER (PARTITION BY k ORDER BY abs(d)) + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2.0::DOUBLE AS r FROM p)
SELECT k, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, count(*) AS n, count(*) FILTER (d = 0) AS n_zero FROM r GROUP BY k""")
def wilcoxon_signed_rank(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.lit(3).alias("a"), (F.col("o_orderkey") % 7).cast("int").alias("b"))
    return stats.wilcoxon(rows, "a", "b", ["k"]).drop("z", "p")


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS x, l_linenumber::DOUBLE AS y, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) + (count(*) OVER (PARTITION BY l_returnflag, l_linenumber) - 1) / 2.0 AS ry FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 9) AS pearson, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY l_returnflag""")
def correlations(spark, d):
    out = stats.correlations(table(spark, d, "lineitem"), "l_quantity", "l_linenumber", ["l_returnflag"])
    return out.select("l_returnflag", F.round("pearson", 9).alias("pearson"), F.round("spearman", 9).alias("spearman"))


@query("""WITH c AS (SELECT l_returnflag AS k, l_quantity AS x, l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY ALL), s AS (SELECT a.k, sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) / 2 AS s, sum(CASE WHEN a.x <> b.x THEN a.n * b.n ELSE 0 END) / 2 AS px, sum(CASE WHEN a.y <> b.y THEN a.n * b.n ELSE 0 END) / 2 AS py FROM c a JOIN c b ON a.k = b.k GROUP BY a.k)
SELECT k AS l_returnflag, s::DOUBLE AS s, px::DOUBLE AS px, py::DOUBLE AS py, round(s / sqrt(px::DOUBLE * py::DOUBLE), 9) AS tau_b FROM s""")
def kendall_tau_b(spark, d):
    return stats.kendall_tau_b(table(spark, d, "lineitem"), "l_quantity", "l_linenumber", ["l_returnflag"]).withColumn("tau_b", F.round("tau_b", 9))


RESULTS = "r AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'm' || (n_nationkey // 4) || '-sd' ELSE 'm' || (n_nationkey // 4) || '-md' END AS model, 'd' || n_regionkey AS dataset, max(n_nationkey) AS score FROM nation GROUP BY ALL)"


def results(spark, d):
    n = F.col("n_nationkey")
    model = F.concat(F.lit("m"), F.floor(n / 4).cast("string"), F.when(n % 2 == 0, "-sd").otherwise("-md"))
    return table(spark, d, "nation").groupBy(model.alias("model"), F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("dataset")).agg(F.max(n).alias("score"))


@query(f"WITH {RESULTS} SELECT * FROM r UNION ALL SELECT regexp_replace(model, '-md$', '-sd') AS m2, dataset, score FROM r WHERE model LIKE '%-md' AND regexp_replace(model, '-md$', '-sd') IN (SELECT model FROM r) AND (regexp_replace(model, '-md$', '-sd') || dataset) NOT IN (SELECT model || dataset FROM r)")
def backfill_models(spark, d):
    return stats.backfill(results(spark, d), "model", "dataset")


@query("SELECT o_orderpriority AS p, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P2 FROM orders GROUP BY 1")
def pivot_report(spark, d):
    orders = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderstatus") == "P", "P2").otherwise(F.col("o_orderstatus")))
    return orders.groupBy(F.col("o_orderpriority").alias("p")).pivot("s", ["F", "O", "P2"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)")
def anti_join(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name").join(table(spark, d, "orders").where("o_totalprice > 350000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2")
def topk_per_group(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "value").withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r")


# ---------------------------------------------------------------- without a SQL twin


@query()
def ground_fuzzy(spark, d):
    """Benchmark items with every eighth word changed, searched in all documents."""
    changed = F.array_join(F.transform(F.split("text", " "), lambda w, i: F.when(i % 8 == 5, "changed").otherwise(w)), " ")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("span_id"), changed.alias("span"))
    return fuzzy.fuzzy_match(items, docs_of(spark, d))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_spans, md5(array_to_string(string_split(text, chr(10)), '|')) AS digest FROM documents")
def parse_repair(spark, d):
    """Lists whose last bracket is missing or whose brackets are braces, of all lines of all texts."""
    rows = docs_of(spark, d).withColumn("j", F.to_json(F.split("text", "\n")))
    broken = F.when(F.col("doc_id") % 2 == 0, F.expr("substr(j, 1, length(j) - 1)")).otherwise(F.concat(F.lit("{"), F.expr("substr(j, 2, length(j) - 2)"), F.lit("}")))
    parsed = rows.select("doc_id", repair.parse_selection_lenient(broken).alias("p"))
    return parsed.select("doc_id", F.when(F.col("p").isNotNull(), F.size("p")).cast("long").alias("n_spans"), F.md5(F.array_join("p", "|")).alias("digest"))


@query()
def html_cards(spark, d):
    """Headings, paragraphs and bold runs of the given pages."""
    return cards.cards(table(spark, d, "pages"), heading="h1", mark="b")


@query()
def evaluate_completions(spark, d):
    """The whole path from raw completions to scores, one document a sample."""
    rows = docs_of(spark, d)
    docs = rows.select(F.col("doc_id").cast("string").alias("sample_id"), F.lit(0).alias("doc_id"), "text")
    refs = rater_spans(rows).where("rater < 2").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("rater").alias("group_ord"), F.lit(0).alias("doc_id"), "start_pos", "end_pos")
    every = docs.select("sample_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("group_ord")).withColumns({c: F.lit(None).cast("int") for c in ("doc_id", "start_pos", "end_pos")})
    predictions = completions(spark, d).select(F.col("doc_id").cast("string").alias("sample_id"), F.col("raw").alias("selection"))
    return evaluate(docs, refs.unionByName(every), predictions, fuzzy=True)["scores"]


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0) GROUP BY conv_id")
def replay_missing(spark, d):
    c = table(spark, d, "conversations")
    keyed = c.withColumn("key", files.cache_key(F.struct("conv_id")))
    known = keyed.where("conv_id % 3 = 0").select("key", F.lit("recorded").alias("completion")).distinct()
    return files.missing(keyed, known).groupBy("conv_id").agg(F.count("*").alias("n"))


from . import catalog_data  # noqa: E402, F401  registers its queries here
from . import catalog_analysis  # noqa: E402, F401
