"""The registered queries of this subpackage: thin wrappers that read a table, apply an operator and name columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster, with_inertia
from .chat import format_conversations, read_back
from .decontaminate import find_leaks
from .divergence import source_divergence
from .html_extract import extract
from .language import identify
from .line_dedup import drop_similar_lines
from .ngram_join import ngram_jaccard_components
from .packing import pack, token_lengths
from .pii import BASE, KINDS, find_pii, listed
from .quality import judge
from .scratch import Scratch
from .sharding import listed as listed_shards
from .sharding import write_shards
from .substring_dedup import drop_repeats

#: The byte limit of a shard, before compression.
SHARD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "quality")
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), save=lambda seen: scratch.save(seen, "signals"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pii")
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), save=lambda x: scratch.save(x, "candidates"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    total = sum((F.size(k) for k in KINDS), F.lit(0)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, total, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"))
    return identify(docs, F.col("lang").isNotNull() & ~F.col("held_out")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_similar_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_shards(write_shards(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'shards').root}/files", limit=SHARD_BYTES))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_lengths(table(spark, sf_dir, "documents")))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = F.get(F.array(*map(F.lit, digests)).cast("array<string>"), "cluster")
    return with_inertia(found).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", named.alias("centroid_sha256"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(added)), arranged=True)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_rules": op3_quality_rules,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_sharding": op9_sharding,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_centroids": op12_centroids,
    "op13_chat_format": op13_chat_format,
}

def op12_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds of assignment and means, written out; integer arithmetic throughout."""
    floor_div = "(s - ((s % n) + n) % n) // n"
    steps = [f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS cluster, x AS c FROM (SELECT x, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM e ORDER BY h, x LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM e, c{r}),
a{r} AS (SELECT * FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, x ORDER BY distance, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""t{r} AS (SELECT cluster, i, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, unnest(range(64)) AS i FROM a{r}) GROUP BY ALL),
m{r} AS (SELECT cluster, list({floor_div} ORDER BY i) AS c FROM t{r} GROUP BY cluster),
c{r + 1} AS (SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON m{r}.cluster = c{r}.cluster)""")
    return ",\n".join(steps) + f"""
SELECT vec_id, a.cluster, distance, sum(distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON f.cluster = a.cluster"""


ORACLE: dict[str, str] = {
    "op11_source_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(list_transform(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, sum(coalesce(c.n, 0)::HUGEINT) OVER (PARTITION BY g.lang, g.source) AS total, v.v
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p FROM f),
l AS (SELECT lang, term, 1 + (1000000000 * (sum(n)::HUGEINT + 5)) // (sum(sum(n)) OVER (PARTITION BY lang)::HUGEINT + 5 * any_value(v)) AS q FROM f GROUP BY lang, term),
x AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS t, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) s ON s.lang = a.lang AND s.s = a.source AND s.t = b.source),
y AS (SELECT p.lang, p.source, p.term AS item, p.p - l.q AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p.p > l.q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM x UNION ALL SELECT lang, source, 'term', item, value FROM y)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u
QUALIFY part = 'pair' OR rank <= 50""",
    "op12_centroids": op12_sql(),
    "op13_chat_format": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
p AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS k,
  replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS escaped FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN (k = 1 AND role <> 'assistant') OR (before IN ('system', 'assistant') AND role = 'user') OR (before = 'user' AND role = 'assistant') THEN NULL
  ELSE '''' || role || ''' after ' || coalesce(before, 'start') END AS fault FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + length(escaped) + 8)::BIGINT AS formatted_chars,
  (count(fault) + (last(role ORDER BY k) <> 'assistant')::INT)::BIGINT AS n_faults,
  coalesce(first(fault ORDER BY k) FILTER (fault IS NOT NULL), CASE WHEN last(role ORDER BY k) <> 'assistant' THEN 'ends after ' || last(role ORDER BY k) END) AS first_fault
FROM f GROUP BY conv_id""",
    "op7_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id""",
    "op9_sharding": f"""WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT d AS depth, h >> (60 - d) AS prefix, sum(n_bytes) AS total FROM h, range(61) t(d) GROUP BY ALL),
c AS (SELECT h.doc_id, h.n_bytes, min(s.depth) AS depth FROM h, range(61) t(d) JOIN s ON s.depth = d AND s.prefix = h >> (60 - d) WHERE s.total <= {SHARD_BYTES} OR s.depth = 60 GROUP BY ALL)
SELECT c.doc_id, c.n_bytes, c.depth, h.h >> (60 - c.depth) AS prefix, 0 AS part FROM c JOIN h ON h.doc_id = c.doc_id""",
    "op8_substring_dedup": r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT h, min(doc_id) AS d FROM g GROUP BY h),
r AS (SELECT DISTINCT g.doc_id, i + k AS p FROM g JOIN m ON m.h = g.h, range(13) t(k) WHERE m.d < g.doc_id),
x AS (SELECT doc_id, list(p) AS p FROM r GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(len(p), 0) AS n_removed, sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(p, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id""",
}
