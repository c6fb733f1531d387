"""Registered queries of statistics, masks, cards, typed selections and filters, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import LINES, TOK, docs_of, draws_sql, query, rater_spans, table
from .functions import variants
from .operators import bootstrap, build, filtering, masking, reports, rouge
from .operators.spans import by_header
from .plans.evaluate import ground_instructions
from .plans.presets import build_preset
from .plans.stages import Stages, shared_root
from .sources import cards

# ---------------------------------------------------------------- statistics

#: P(Z > x) for numbers between -6 and 6 by a series of positive terms.
TAIL = "(0.5::DOUBLE - sign({0}) * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda n: exp((2 * n + 1) * ln(greatest(abs({0}), 1e-300)) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1)))))"
SHARE = "SELECT source || ':' || lang AS g, doc_id AS id, n_chars::DOUBLE AS v, source, lang FROM documents"


@query(f"""WITH {draws_sql(SHARE, 'g', 1000)}, d AS (SELECT split_part(g, ':', 1) AS source, draw, avg(m) AS d FROM m GROUP BY ALL),
c AS (SELECT source, g, v, avg(v) OVER (PARTITION BY g) AS mean, count(*) OVER (PARTITION BY g) AS n FROM v),
j AS (SELECT source, sum(CASE WHEN n > 1 THEN ((v - mean) / ((n - 1) * n::DOUBLE)) ** 3 ELSE 0 END) / (6 * sum(CASE WHEN n > 1 THEN ((v - mean) / ((n - 1) * n::DOUBLE)) ** 2 ELSE 0 END) ** 1.5) AS acceleration FROM c GROUP BY source),
t AS (SELECT source, avg(m) AS macro FROM (SELECT source, g, avg(v) AS m FROM v GROUP BY ALL) GROUP BY source)
SELECT source, round(macro, 6) AS macro, round(acceleration, 9) AS acceleration, (count(*) FILTER (d < macro - 1e-12 * macro) + 0.5::DOUBLE * count(*) FILTER (abs(d - macro) <= 1e-12 * macro)) / count(*) AS below, count(*) AS draws
FROM d JOIN t USING (source) JOIN j USING (source) GROUP BY ALL""")
def bootstrap_sides(spark, d):
    """What the accelerated bootstrap's limits are made from, for lengths of texts by source, averaged over languages."""
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    out = bootstrap.bootstrap_bca(rows, "n_chars", "lang", "doc_id", ["source"], draws=1000)
    return out.select("source", F.round("macro", 6).alias("macro"), F.round("acceleration", 9).alias("acceleration"), "below", "draws")


@query()
def bootstrap_bca(spark, d):
    """10,000 draws; the plain version in the tests works the limits out draw by draw."""
    rows = table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars")
    return bootstrap.bootstrap_bca(rows, "n_chars", "lang", "doc_id", ["source"])


#: Student's two-sided share inside t for {1} degrees: finite sums over powers of the cosine, even and odd.
INSIDE = """(CASE WHEN {1} % 2 = 0 THEN sin(atan({0} / sqrt({1}))) * list_sum(list_transform(range(0, {1} // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * cos(atan({0} / sqrt({1}))) ** (2 * k)))
ELSE 2 / pi() * (atan({0} / sqrt({1})) + sin(atan({0} / sqrt({1}))) * coalesce(list_sum(list_transform(range(0, ({1} - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * cos(atan({0} / sqrt({1}))) ** (2 * k + 1))), 0)) END)"""


def _intervals(rows: str, keys: str) -> str:
    """Half-widths by bisection of t for each size of group."""
    return f"""s AS (SELECT {keys}, count(*) AS n, avg(coalesce(x, 0)) AS mean, stddev_samp(coalesce(x, 0)) AS sd FROM ({rows}) GROUP BY ALL),
b AS (SELECT DISTINCT n - 1 AS nu, 0.0::DOUBLE AS lo, 100.0::DOUBLE AS hi, 0 AS i FROM s WHERE n > 1
  UNION ALL SELECT nu, CASE WHEN {INSIDE.format('((lo + hi) / 2)', 'nu')} < 0.9 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {INSIDE.format('((lo + hi) / 2)', 'nu')} < 0.9 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM b WHERE i < 48),
w AS (SELECT {keys}, s.n, mean, sd / sqrt(s.n) * lo AS half_width FROM s LEFT JOIN b ON b.nu = s.n - 1 AND b.i = 48)"""


@query(f"WITH RECURSIVE {_intervals('SELECT source, lang, CASE WHEN n_chars > 300 THEN n_chars::DOUBLE END AS x FROM documents', 'source, lang')} SELECT source, lang, n, round(mean, 6) AS mean, round(half_width, 6) AS half_width FROM w")
def score_intervals(spark, d):
    """Mean lengths with half-widths of 90 %; texts of 300 characters or less count as missing, that is as 0."""
    rows = table(spark, d, "documents").select("source", "lang", F.when(F.col("n_chars") > 300, F.col("n_chars").cast("double")).alias("x"))
    return reports.interval(rows, "x", ["source", "lang"]).select("source", "lang", "n", F.round("mean", 6).alias("mean"), F.round("half_width", 6).alias("half_width"))


PAIRED_SCORES = """sc AS (SELECT 'm' || o_orderkey % 3 AS model, o_orderpriority AS dataset, o_orderkey // 3 AS sample_id, (o_totalprice % 50)::INT::DOUBLE + o_orderkey % 3 AS score FROM orders),
pr AS (SELECT a.model AS a, b.model AS b, a.dataset, a.sample_id AS id, a.score AS sa, b.score AS sb, a.score - b.score AS d FROM sc a JOIN sc b ON a.dataset = b.dataset AND a.sample_id = b.sample_id AND (a.model, b.model) IN (('m2', 'm0'), ('m1', 'm0'), ('m0', 'm2')))"""


@query(f"""WITH {PAIRED_SCORES}, r AS (SELECT *, rank() OVER (PARTITION BY a, b, dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, dataset, abs(d)) - 1) / 2.0::DOUBLE AS r FROM pr),
w AS (SELECT a, b, dataset, count(*) AS n, avg(sa) AS mean_a, avg(sb) AS mean_b, coalesce(sum(r) FILTER (d > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r * r) FILTER (d <> 0), 0)::DOUBLE AS ss, count(*) FILTER (d = 0) AS z FROM r GROUP BY ALL),
x AS (SELECT *, (w_plus - (n * (n + 1) - z * (z + 1)) / 4) / sqrt(ss / 4) AS zs FROM w)
SELECT a, b, dataset, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, w_plus, round(zs, 6) AS z, round({TAIL.format('zs')}, 8) AS p_signed_rank FROM x""")
def signed_rank_pairs(spark, d):
    return paired_scores(spark, d).select("a", "b", "dataset", "n", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), "w_plus", F.round("z", 6).alias("z"), F.round("p_signed_rank", 8).alias("p_signed_rank"))


def paired_scores(spark, d):
    k = F.col("o_orderkey") % 3
    scores = table(spark, d, "orders").select(F.concat(F.lit("m"), k.cast("string")).alias("model"), F.col("o_orderpriority").alias("dataset"), F.floor(F.col("o_orderkey") / 3).alias("sample_id"), (F.rint(F.col("o_totalprice") % 50) + k).cast("double").alias("score"))
    return reports.paired_tests(scores, [("m2", "m0"), ("m1", "m0"), ("m0", "m2")], draws=200)


@query()
def paired_tests(spark, d):
    """All tests at once; signed ranks have a twin of their own, intervals too, and sign flips in ``paired_permutation``."""
    return paired_scores(spark, d)

# ---------------------------------------------------------------- typed selections


def mixed_selections(spark, d):
    """A document's lines as a selection of eight kinds in turn, as JSON."""
    lines, k = F.split("text", "\n"), F.col("doc_id") % 8
    said = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    span = lambda s: F.struct(F.lit(0).alias("doc_id"), F.lit(0).alias("start_pos"), F.length(s).alias("end_pos"), s.alias("content"), F.lit("exact").alias("mode"))
    json = (
        F.when(k == 1, "[]").when(k == 2, F.to_json(F.transform(lines, span))).when(k == 3, said(F.concat(F.lit("Selected Content:\n"), F.to_json(lines))))
        .when(k == 4, said(F.concat(F.lit("no list "), F.regexp_replace("text", r'[\[\]"]', "")))).when(k == 5, F.to_json(lines)).when(k == 6, '{"doc_id":0}').when(k == 7, F.concat(F.lit('["x",'), F.length("text").cast("string"), F.lit("]")))
    )
    return docs_of(spark, d).select("doc_id", json.alias("j"))


MIXED = r"""l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
j AS (SELECT doc_id, (CASE doc_id % 8 WHEN 1 THEN '[]' WHEN 2 THEN to_json(list_transform(l, lambda s: {'doc_id': 0, 'start_pos': 0, 'end_pos': length(s), 'content': s, 'mode': 'exact'}))::VARCHAR WHEN 3 THEN to_json('Selected Content:' || chr(10) || to_json(l)::VARCHAR)::VARCHAR
  WHEN 4 THEN to_json('no list ' || regexp_replace(text, '[\[\]"]', '', 'g'))::VARCHAR WHEN 5 THEN to_json(l)::VARCHAR WHEN 6 THEN '{"doc_id":0}' WHEN 7 THEN '["x",' || length(text) || ']' END)::JSON AS j FROM l),
t AS (SELECT doc_id, j, json_type(j) AS t, CASE WHEN json_type(j) = 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda i: json_type(j -> i)) END AS e, CASE WHEN json_type(j) = 'VARCHAR' THEN replace(j ->> '$', 'Selected Content:' || chr(10), '') END AS s FROM j),
k AS (SELECT *, CASE WHEN j IS NULL OR t = 'NULL' THEN 'missing' WHEN t = 'ARRAY' AND len(e) = 0 THEN 'empty' WHEN t = 'ARRAY' AND len(list_filter(e, lambda x: x <> 'OBJECT')) = 0 AND json_exists(j, '$[0].content') THEN 'grounded' WHEN t = 'ARRAY' AND len(list_filter(e, lambda x: x <> 'VARCHAR')) = 0 THEN 'parsed'
  WHEN t = 'VARCHAR' AND json_valid(s) AND json_type(s) = 'ARRAY' THEN 'parsed' ELSE 'unreadable' END AS kind FROM t)"""


@query(f"""WITH {MIXED} SELECT doc_id, kind, CASE kind WHEN 'empty' THEN 0 WHEN 'grounded' THEN json_array_length(j) WHEN 'parsed' THEN json_array_length(CASE WHEN t = 'VARCHAR' THEN s::JSON ELSE j END) END::BIGINT AS n,
CASE WHEN kind = 'parsed' THEN md5(array_to_string(from_json(CASE WHEN t = 'VARCHAR' THEN s::JSON ELSE j END, '["VARCHAR"]'), '|')) WHEN kind = 'grounded' THEN md5(array_to_string(list_transform(range(json_array_length(j)::BIGINT), lambda i: (j -> i) ->> 'content'), '|')) END AS digest,
CASE WHEN kind = 'grounded' THEN list_sum(list_transform(range(json_array_length(j)::BIGINT), lambda i: ((j -> i) ->> 'end_pos')::BIGINT))::BIGINT END AS ends FROM k""")
def typed_selections(spark, d):
    s = mixed_selections(spark, d).select("doc_id", variants.typed_selection(F.col("j")).alias("s"))
    content = F.array_join(F.transform("s.spans", lambda x: x["content"]), "|")
    n = F.coalesce(F.when(F.col("s.texts").isNotNull(), F.size("s.texts")), F.when(F.col("s.spans").isNotNull(), F.size("s.spans"))).cast("long")
    digest = F.when(F.col("s.kind") == "parsed", F.md5(F.array_join("s.texts", "|"))).when(F.col("s.kind") == "grounded", F.md5(content))
    ends = F.when(F.col("s.kind") == "grounded", F.aggregate("s.spans", F.lit(0).cast("long"), lambda a, x: a + x["end_pos"]))
    return s.select("doc_id", "s.kind", n.alias("n"), digest.alias("digest"), ends.alias("ends"))


# ---------------------------------------------------------------- cards


def card_pages(spark, d):
    """Three lines of a document a card: heading, citation, and a text of which every third word is marked."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.split("text", "\n")
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i % 3 == 0)
    marked = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w, i: F.when(i % 3 == 1, F.concat(F.lit("<U>"), w, F.lit("</u>"))).otherwise(w)), " ")
    at = lambda i, k: escaped(F.get(lines, i + k))
    card = lambda i: F.concat(F.lit("<h4>"), at(i, 0), F.lit("</h4>"), F.coalesce(F.concat(F.lit("<p class=c>"), at(i, 1)), F.lit("")), F.coalesce(F.concat(F.lit("<p>"), marked(at(i, 2)), F.lit("</p>")), F.lit("")))
    return docs_of(spark, d).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<html><body>"), F.array_join(F.transform(starts, card), "\n"), F.lit("</body></html>")).alias("html"))


SPACED = r"len(regexp_extract_all({0}, '[^\s\p{{Z}}]+'))"


@query(rf"""WITH l AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS l FROM documents),
c AS (SELECT page_id, (i // 3)::INT AS card, l[i + 1] AS abstract, l[i + 2] AS citation, l[i + 3] AS document, string_split(l[i + 3], ' ') AS w FROM l, LATERAL (SELECT unnest(range(0, len(l), 3)) AS i)),
e AS (SELECT *, list_filter(w, lambda x, i: i % 3 = 2) AS u, list_filter(range(0, len(w)), lambda i: i % 3 = 1) AS ix FROM c),
s AS (SELECT *, array_to_string(u, ' ') AS extract, list_sum(list_transform(ix, lambda i: coalesce(list_sum(list_transform(w[1:i], lambda x: length(x) + 1)), 0))) AS starts FROM e),
n AS (SELECT *, {SPACED.format('document')} AS dw, {SPACED.format('abstract')} AS aw, {SPACED.format('extract')} AS ew FROM s),
r AS (SELECT *, CASE WHEN dw >= 20 THEN row_number() OVER (PARTITION BY document, dw >= 20 ORDER BY page_id, card) END AS copy FROM n),
j AS (SELECT *, CASE WHEN citation IS NULL THEN 'no_paragraph' WHEN document IS NULL THEN 'empty' WHEN dw < 20 THEN 'too_short' WHEN copy > 1 THEN 'duplicate' WHEN ew <= 10 OR aw <= 3 THEN 'too_short' WHEN aw >= dw OR ew >= dw THEN 'too_long' ELSE 'valid' END AS status FROM r)
SELECT page_id, card, status, CASE WHEN status = 'valid' THEN (row_number() OVER (PARTITION BY page_id, status = 'valid' ORDER BY card) - 1)::INT END AS card_id, md5(extract) AS extract, CASE WHEN document IS NOT NULL THEN len(u) END::BIGINT AS n_spans, CASE WHEN len(u) > 0 THEN starts END::BIGINT AS starts FROM j""")
def debate_cards(spark, d):
    judged = cards.judge_cards(cards.cards(card_pages(spark, d)))
    starts = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["start_pos"])
    return judged.select("page_id", "card", "status", "card_id", F.md5("extract").alias("extract"), F.when(F.col("document").isNotNull(), F.size("spans")).cast("long").alias("n_spans"), F.when(F.size("spans") > 0, starts).alias("starts"))


@query("SELECT 'total' AS status, count(*) AS n FROM pages WHERE html LIKE '%<h1>%' UNION ALL SELECT 'no_paragraph', count(*) FROM pages WHERE html LIKE '%<h1>%' AND NOT regexp_matches(split_part(html, '<h1>', 2), '<p[ >]') HAVING count(*) > 0")
def card_counts_no_paragraph(spark, d):
    """Headings of the given pages and those without a paragraph after them."""
    judged = cards.judge_cards(cards.cards(table(spark, d, "pages"), heading="h1", mark="b"))
    return cards.skip_counts(judged).where("status in ('total', 'no_paragraph')")


# ---------------------------------------------------------------- training labels

TOKEN = r"<\|im_start\|>|<\|im_end\|>|[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"


@query(rf"""WITH t AS (SELECT conv_id, turn, role, unnest(k) AS token, unnest(range(len(k))) AS i FROM (SELECT *, regexp_extract_all('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>', '{TOKEN}') AS k FROM conversations)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS pos, ('0x' || substr(md5(token), 1, 7))::INT AS id FROM t),
c AS (SELECT *, bool_or(token = '<|im_end|>') OVER (PARTITION BY conv_id, turn) AS whole FROM p WHERE pos <= 200),
n AS (SELECT *, lead(role) OVER w AS next_role, lead(whole) OVER w AS next_whole FROM (SELECT DISTINCT conv_id, turn, role, whole FROM c) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT c.conv_id, c.pos, c.id, c.whole AND (c.role <> 'assistant' OR (c.token = '<|im_end|>' AND coalesce(n.next_whole AND n.next_role <> 'assistant', false))) AS masked FROM c JOIN n ON n.conv_id = c.conv_id AND n.turn = c.turn)
SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (masked) AS n_masked, md5(string_agg(CASE WHEN masked THEN '-100' ELSE id::VARCHAR END, ',' ORDER BY pos)) AS labels, any_value(total) > count(*) FILTER (ended) AS too_long
FROM m JOIN (SELECT conv_id, pos, token = '<|im_end|>' AS ended FROM p) e USING (conv_id, pos) JOIN (SELECT conv_id, count(*) AS total FROM conversations GROUP BY 1) USING (conv_id) GROUP BY conv_id""")
def masked_labels(spark, d):
    """Labels of the first 200 tokens of each conversation."""
    out = masking.conversation_labels(table(spark, d, "conversations"), ["conv_id"], seq_length=200)
    masked = F.size(F.filter("labels", lambda x: x == masking.IGNORE)).cast("long")
    return out.select("conv_id", F.size("labels").cast("long").alias("n_tokens"), masked.alias("n_masked"), F.md5(F.array_join("labels", ",")).alias("labels"), "too_long")


# ---------------------------------------------------------------- ROUGE


@query()
def rouge_stemmed(spark, d):
    """All of ROUGE between the first and the second half of each whole text; the tests hold it against tables of a plain version."""
    half = F.floor(F.length("text") / 2).cast("int")
    return rouge.rouge(docs_of(spark, d), ["doc_id"], F.substr("text", F.lit(1), half), F.substr("text", half + 1))

# ---------------------------------------------------------------- annotated samples

FILTERED = f"""{TOK}, {LINES}, near AS (SELECT doc_id, tok, lead(start_pos) OVER w AS nx, lag(end_pos) OVER w AS pv FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok)),
g AS (SELECT doc_id AS sample, rater, line_no, start_pos, end_pos, (doc_id + rater + line_no) % 5 = 0 AS lost FROM spans WHERE doc_id % 9 <> 0),
z AS (SELECT sample, rater, count(*) FILTER (NOT lost) AS n FROM g GROUP BY ALL),
c AS (SELECT sample, count(*) FILTER (n > 0) AS n_groups, count(*) FILTER (n = 0) AS n_dropped FROM z GROUP BY sample),
ids AS (SELECT DISTINCT s.sample, s.rater, k.tok FROM g s JOIN near k ON k.doc_id = s.sample AND (k.nx > s.start_pos OR k.nx IS NULL) AND (k.pv < s.end_pos OR k.pv IS NULL) WHERE NOT lost),
v AS (SELECT sample, tok FROM ids GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT sample, count(*) AS n_merged FROM v GROUP BY sample),
sz AS (SELECT sample, rater, count(*) AS t FROM ids GROUP BY ALL), rs AS (SELECT z.sample, z.rater, coalesce(t, 0) AS t FROM z LEFT JOIN sz USING (sample, rater) WHERE n > 0),
ov AS (SELECT x.sample, x.rater AS a, y.rater AS b, count(*) AS o FROM ids x JOIN ids y ON x.sample = y.sample AND x.tok = y.tok AND x.rater < y.rater GROUP BY ALL),
ag AS (SELECT x.sample, avg(CASE WHEN x.t = 0 AND y.t = 0 THEN 1.0::DOUBLE WHEN coalesce(o, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * o / (x.t + y.t) END) AS agreement
  FROM rs x JOIN rs y ON y.sample = x.sample AND x.rater < y.rater LEFT JOIN ov ON ov.sample = x.sample AND ov.a = x.rater AND ov.b = y.rater GROUP BY x.sample),
j AS (SELECT doc_id AS sample, doc_id % 9 = 0 AS neg, source, coalesce(n_groups, 0) AS n_groups, coalesce(n_dropped, 0) AS n_dropped, agreement, coalesce(n_merged, 0) AS n_merged FROM documents d LEFT JOIN c ON c.sample = doc_id LEFT JOIN m ON m.sample = doc_id LEFT JOIN ag ON ag.sample = doc_id),
r AS (SELECT *, CASE WHEN neg THEN NULL WHEN n_groups < 2 THEN 'partial_annotators' WHEN agreement < 0.15 THEN 'low_agreement' WHEN n_merged = 0 THEN 'empty_merge' END AS reason FROM j),
f AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY source ORDER BY reason IS NOT NULL, sample) > 8 THEN 'beyond_first' ELSE reason END AS status FROM r)"""


def annotated(spark, d):
    docs = docs_of(spark, d).withColumn("sample_id", F.col("doc_id"))
    samples = table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 9 == 0).alias("is_negative"), F.col("source").alias("set_id"), F.col("doc_id").alias("ord"))
    lost = (F.col("doc_id") + F.col("rater") + F.col("line_no")) % 5 == 0
    groups = rater_spans(docs).select(F.col("doc_id").alias("sample_id"), F.col("rater").alias("group_id"), F.when(lost, -1).otherwise(0).alias("doc_id"), "start_pos", "end_pos")
    named = groups.withColumn("group_id", F.concat(F.lit("m"), F.col("group_id").cast("string")))
    return filtering.filter_annotated(samples, named, docs.select("sample_id", F.lit(0).alias("doc_id"), "text"), raters=2, least_votes=3, least_agreement=0.15, first=8)


@query(f"WITH {FILTERED} SELECT sample AS sample_id, n_groups, n_dropped, round(agreement, 9) AS agreement, n_merged, status FROM f")
def filter_decisions(spark, d):
    _, decisions = annotated(spark, d)
    return decisions.select("sample_id", "n_groups", "n_dropped", F.round("agreement", 9).alias("agreement"), "n_merged", "status")


@query(f"""WITH {FILTERED}, isl AS (SELECT sample, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT v.sample, t.start_pos, t.end_pos, v.tok - row_number() OVER (PARTITION BY v.sample ORDER BY v.tok) AS gr FROM v JOIN tok t ON t.doc_id = v.sample AND t.tok = v.tok) GROUP BY sample, gr),
o AS (SELECT g.sample, 'm' || g.rater AS group_id, g.start_pos, g.end_pos FROM g JOIN f ON f.sample = g.sample AND f.status IS NULL WHERE NOT lost
  UNION ALL SELECT i.sample, 'Merged', i.start_pos, i.end_pos FROM isl i JOIN f ON f.sample = i.sample AND f.status IS NULL
  UNION ALL SELECT s.doc_id, 'm' || s.rater, s.start_pos, s.end_pos FROM spans s JOIN f ON f.sample = s.doc_id AND f.status IS NULL WHERE f.neg)
SELECT sample AS sample_id, group_id, count(*) AS n, sum(start_pos)::BIGINT AS sum_start, sum(end_pos)::BIGINT AS sum_end FROM o GROUP BY ALL""")
def filter_merged(spark, d):
    kept, _ = annotated(spark, d)
    return kept.groupBy("sample_id", "group_id").agg(F.count("*").alias("n"), F.sum("start_pos").alias("sum_start"), F.sum("end_pos").alias("sum_end"))


@query(f"""WITH {FILTERED} SELECT count(*) AS samples, count(*) FILTER (status IS NULL) AS kept, count(*) FILTER (status = 'partial_annotators') AS partial_annotators, count(*) FILTER (status = 'low_agreement') AS low_agreement, count(*) FILTER (status = 'empty_merge') AS empty_merge, count(*) FILTER (status = 'beyond_first') AS beyond_first, sum(n_dropped)::BIGINT AS dropped_groups FROM f""")
def filter_counters(spark, d):
    _, decisions = annotated(spark, d)
    return decisions.agg(*filtering.counters())

# ---------------------------------------------------------------- grounding, headers and training rows


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, text, l, array_to_string(list_reverse(l), chr(10)) AS back FROM l),
e AS (SELECT doc_id, text, back, i, l[i + 1] AS span FROM r, LATERAL (SELECT unnest(range(len(l))) AS i)),
p AS (SELECT doc_id, i, span, CASE WHEN i % 3 = 1 THEN 1 ELSE 0 END AS d, instr(CASE WHEN i % 3 = 1 THEN back ELSE text END, span) - 1 AS s FROM e)
SELECT doc_id AS sample_id, 'part ' || (i % 2) AS instruction, (i // 2)::INT AS span_ord, CASE WHEN regexp_matches(span, '^[\\s\\p{Z}]*$') THEN -1 ELSE d END AS doc_id, CASE WHEN regexp_matches(span, '^[\\s\\p{Z}]*$') THEN -1 ELSE s END::INT AS start_pos FROM p""")
def grounded_instructions(spark, d):
    """Every line of a document under two instructions, in two documents of a sample: the text and its lines from the end; a third of the lines hint at the second."""
    lines = F.split("text", "\n")
    rows = docs_of(spark, d)
    docs = rows.select(F.col("doc_id").alias("sample_id"), F.posexplode(F.array(F.col("text"), F.array_join(F.reverse(lines), "\n"))).alias("doc_id", "text"))
    hint = lambda i: F.when(i % 3 == 1, 1).when(i % 3 == 2, 0).cast("int")
    spans = F.transform(lines, lambda x, i: F.struct(x.alias("span"), hint(i).alias("hint"), i.alias("i")))
    part = lambda k: F.transform(F.filter(spans, lambda s: s["i"] % 2 == k), lambda s: F.struct(s["span"].alias("span"), s["hint"].alias("hint")))
    maps = rows.select(F.col("doc_id").alias("sample_id"), F.create_map(F.lit("part 0"), part(0), F.lit("part 1"), part(1)).alias("selections"))
    return ground_instructions(maps, docs, fuzzy=False).select("sample_id", "instruction", "span_ord", "doc_id", "start_pos")


@query(f"""WITH {LINES}, n AS (SELECT doc_id, line_no, line, line_no // 4 AS part FROM lines),
h AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY line_no) AS body FROM n GROUP BY ALL),
s AS (SELECT n.doc_id, n.part, n.line_no, sum(length(m.line) + 1) AS s FROM n LEFT JOIN n m ON m.doc_id = n.doc_id AND m.part = n.part AND m.line_no < n.line_no GROUP BY ALL)
SELECT s.doc_id AS sample_id, s.line_no, s.part::INT AS doc_id, coalesce(s, 0)::INT AS start_pos, (coalesce(s, 0) + length(l.line))::INT AS end_pos FROM s JOIN lines l USING (doc_id, line_no) WHERE length(l.line) > 0""")
def header_offsets(spark, d):
    """Four lines a document under numbered headers, and every line's place in the joined text rebased to its own document."""
    lines = F.split("text", "\n")
    header = lambda k: F.concat(F.lit("\n-~- Document #"), k.cast("string"), F.lit(" -~-\n\n"))
    rows = docs_of(spark, d).select(F.col("doc_id").alias("sample_id"), lines.alias("l"))
    text = F.array_join(F.transform("l", lambda x, i: F.concat(F.when(i % 4 == 0, header(F.floor(i / 4).cast("int"))).otherwise(F.lit("\n")), x)), "")
    texts = rows.select("sample_id", "l", text.alias("text"))
    lead = lambda x, i: F.when(i % 4 == 0, F.length(header(F.floor(i / 4).cast("int")))).otherwise(1)
    each = texts.select("sample_id", F.posexplode(F.transform("l", lambda x, i: F.struct(lead(x, i).alias("before"), F.length(x).alias("n")))).alias("line_no", "x"))
    ends = F.sum(F.col("x.before") + F.col("x.n")).over(Window.partitionBy("sample_id").orderBy("line_no")).cast("int")
    spans = each.select("sample_id", "line_no", (ends - F.col("x.n")).alias("start_pos"), ends.alias("end_pos")).where("end_pos > start_pos")
    return by_header(spans, texts.select("sample_id", "text"), r"\n?-~- Document #(\d+) -~-\n\n")


@query("""WITH c AS (SELECT source AS dataset, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'dev' ELSE 'test' END AS split, n_chars AS tokens FROM documents)
SELECT CASE grouping(dataset) * 2 + grouping(split) WHEN 0 THEN 'both' WHEN 1 THEN 'dataset' WHEN 2 THEN 'split' ELSE 'all' END AS level, dataset, split, count(*) AS samples, sum(tokens)::BIGINT AS tokens FROM c GROUP BY GROUPING SETS ((), (dataset), (split), (dataset, split))""")
def token_totals(spark, d):
    k = F.col("doc_id") % 10
    costs = table(spark, d, "documents").select(F.col("source").alias("dataset"), F.when(k < 7, "train").when(k == 7, "dev").otherwise("test").alias("split"), F.col("n_chars").alias("tokens"))
    return build.token_totals(costs)


@query("""WITH n AS (SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id::VARCHAR ELSE coalesce(lang, 'none') || '.' || doc_id END AS id FROM documents), s AS (SELECT id, CASE WHEN contains(id, '.') THEN split_part(id, '.', 1) ELSE 'NEG' END AS s FROM n),
z AS (SELECT s, count(*) AS n, sum(count(*)) OVER () AS t FROM s GROUP BY s), e AS (SELECT s, n * floor(t * 0.3::DOUBLE) / t AS e, floor(t * 0.3::DOUBLE) AS want FROM z),
q AS (SELECT s, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, s) <= want - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS q FROM e),
r AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY md5(id || ':42'), id) AS r FROM s)
SELECT id AS sample_id, row_number() OVER (ORDER BY md5(id || ':42'), id) AS place FROM r JOIN q USING (s) WHERE r <= q""")
def training_rows(spark, d):
    """Three tenths of the documents by language, in a random order whose places are told by the partitions' sizes."""
    lang = F.concat(F.coalesce("lang", F.lit("none")), F.lit("."))
    ids = table(spark, d, "documents").select(F.concat(F.when(F.col("doc_id") % 11 == 0, "").otherwise(lang), F.col("doc_id").cast("string")).alias("sample_id"))
    rows = build.training_share(ids, "sample_id", 0.3)
    order = build.numbered_draws(rows.withColumn("all", F.lit(0)), "all", "sample_id", 42)
    return order.select("sample_id", (F.col("_p") + 1).alias("place"))


SETS = "sets AS (SELECT DISTINCT doc_id // 3 AS set_id, CASE WHEN (doc_id // 3) % 2 = 0 THEN 'text' ELSE 'code' END AS type FROM documents)"


def preset_sources(spark, d):
    """Documents as samples, three of neighbouring ids a set, annotated by three models."""
    docs = docs_of(spark, d)
    named = lambda c: F.concat(F.lit("s"), c.cast("string"))
    set_id = F.floor(F.col("doc_id") / 3)
    samples = docs.select(named(F.col("doc_id")).alias("sample_id"), set_id.alias("set_id"), F.col("doc_id").alias("ord"), F.when(set_id % 2 == 0, "text").otherwise("code").alias("type"), (F.col("doc_id") % 9 == 0).alias("is_negative"), F.lit("Select lines.").alias("instruction"))
    models = F.element_at(F.array(*map(F.lit, ("Claude3-Opus", "GPT4", "Gemini-1.5"))), (F.col("rater") + 1).cast("int"))
    groups = rater_spans(docs).select(named(F.col("doc_id")).alias("sample_id"), models.alias("group_id"), F.lit(0).alias("doc_id"), F.col("start_pos").cast("int").alias("start_pos"), F.col("end_pos").cast("int").alias("end_pos"))
    return {"samples": samples, "groups": groups, "docs": docs.select(named(F.col("doc_id")).alias("sample_id"), F.lit(0).alias("doc_id"), "text")}


@query(f"""WITH {TOK}, {LINES}, {SETS}, near AS (SELECT doc_id, tok, lead(start_pos) OVER w AS nx, lag(end_pos) OVER w AS pv FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY tok)),
ids AS (SELECT DISTINCT s.doc_id, s.rater, k.tok FROM spans s JOIN near k ON k.doc_id = s.doc_id AND (k.nx > s.start_pos OR k.nx IS NULL) AND (k.pv < s.end_pos OR k.pv IS NULL) WHERE s.doc_id % 9 <> 0),
c AS (SELECT doc_id, count(DISTINCT rater) AS n FROM spans GROUP BY doc_id), v AS (SELECT doc_id, tok FROM ids GROUP BY ALL HAVING count(*) >= 2),
isl AS (SELECT doc_id, min(start_pos) AS start_pos, max(end_pos) AS end_pos FROM (SELECT v.doc_id, t.start_pos, t.end_pos, v.tok - row_number() OVER (PARTITION BY v.doc_id ORDER BY v.tok) AS gr FROM v JOIN tok t ON t.doc_id = v.doc_id AND t.tok = v.tok) GROUP BY doc_id, gr),
o AS (SELECT set_id, row_number() OVER (PARTITION BY type ORDER BY md5(set_id || ':42'), set_id) - 1 AS p, count(*) OVER (PARTITION BY type) AS n FROM sets),
f AS (SELECT set_id, CASE WHEN p < floor(n * 0.7) THEN 'train' WHEN p < floor(n * 0.7) + floor(n * 0.1) THEN 'dev' ELSE 'test' END AS split FROM o)
SELECT 's' || d.doc_id AS sample_id, f.split, CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE 'Merged' END AS group_id, count(i.start_pos) AS n, coalesce(sum(i.start_pos), 0)::BIGINT AS sum_start, coalesce(sum(i.end_pos), 0)::BIGINT AS sum_end
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN f ON f.set_id = d.doc_id // 3 LEFT JOIN isl i ON i.doc_id = d.doc_id WHERE c.n = 3 OR (d.doc_id % 9 = 0 AND c.n > 0) GROUP BY d.doc_id, f.split""")
def preset_majority(spark, d):
    """The preset by majority from annotated documents to its answers, through written stages."""
    stages = Stages(spark, shared_root(spark, f"presets-{uuid.uuid4().hex[:12]}"), preset_sources(spark, d))  # a folder of its own: the query does all its work
    out = build_preset(stages, "majority", "You select.")["answers"]
    total = lambda c: F.aggregate("selections", F.lit(0).cast("long"), lambda a, s: a + s[c])
    return out.select("sample_id", "split", "group_id", F.size("selections").cast("long").alias("n"), total("start_pos").alias("sum_start"), total("end_pos").alias("sum_end"))
