"""The queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, divergence, language, licenses, lm, neardup, packing, quality, secrets, sharding, toxicity, warc
from .base import prepare, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_minhash_near_dedup, op4_packing, op5_warc, op6_lm_scoring, op7_decontamination, op8_quality_rules, op9_sharding, op10_license_scan, op11_source_divergence, op12_language_id, op13_centroid_clustering)}

ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_minhash_near_dedup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common c JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c.n >= 85 * (p.n + q.n - c.n)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reached JOIN links ON x = b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON a = d.doc_id""",
    "op5_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f, list_transform(range(4), lambda j: ('0x' || substr(h, 1 + 10 * j, 10))::BIGINT) AS v FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + k // 8] >> (35 - 5 * (k % 8))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM d""",
    "op7_decontamination": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) AS t FROM b WHERE len(w) > 0),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM w, (SELECT DISTINCT n FROM windows) k, unnest(range(1, len(w) - n + 2)) AS u(i)),
hits AS (SELECT doc_id, item, i, s.n FROM spots s JOIN windows USING (n, t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
}

# centroids as lists, round by round; floor division of integers of either sign
_ROUND = """a{k} AS (SELECT q, n, c, d FROM (SELECT v.q, v.n, m.c, list_sum(list_transform(list_zip(v.q, m.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d,
  row_number() OVER (PARTITION BY v.q ORDER BY list_sum(list_transform(list_zip(v.q, m.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), m.c) AS r FROM distinct_v v, m{k} m) WHERE r = 1)"""
_MOVE = """s{k} AS (SELECT c, j, sum(n * q[j]) AS s, sum(n) AS n FROM a{k}, unnest(range(1, 65)) AS u(j) GROUP BY c, j),
u{k} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY j) AS v FROM s{k} GROUP BY c),
m{next} AS (SELECT m.c, coalesce(u.v, m.v) AS v FROM m{k} m LEFT JOIN u{k} u USING (c))"""
ORACLE_SQL |= {
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(term)::HUGEINT AS v, coalesce(sum(total), 0)::HUGEINT AS a FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN k USING (lang) GROUP BY 1),
n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
o AS (SELECT lang, source, sum(n)::HUGEINT AS o FROM c GROUP BY 1, 2),
p AS (SELECT c.*, 1 + (1000000000 * (n + 1)) // (o + v) AS p, 1 + (1000000000 * (total + 1)) // (a + v) AS q FROM c JOIN o USING (lang, source) JOIN v USING (lang)),
x AS (SELECT lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
word AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM word)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200""",
    "op13_centroid_clustering": """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
distinct_v AS (SELECT q, count(*) AS n FROM good GROUP BY 1),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q AS v FROM good QUALIFY c < 16),
"""
    + ",\n".join(f"{_ROUND.format(k=k)}" + (",\n" + _MOVE.format(k=k, next=k + 1) if k < 3 else "") for k in range(4))
    + """
SELECT vec_id, a.c::INT AS cluster, d AS distance, i.s::BIGINT AS cluster_inertia, (SELECT sum(n * d) FROM a3)::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM good JOIN a3 a USING (q) JOIN (SELECT c, sum(n * d) AS s FROM a3 GROUP BY 1) i ON i.c = a.c JOIN m3 m ON m.c = a.c""",
}

__all__ = ["ORACLE_SQL", "QUERIES", "prepare"]
