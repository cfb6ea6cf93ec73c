"""Queries of the column functions over names, ratios and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import learner as L
from .catalogue import META, meta
from .queries import ATT, AS_OF, attempts, query, t

CODES = {"cbt": "Computer test", "pdf": "Document"}


@query(f"WITH {META} SELECT id, name AS collapsed, lower(name) || '::' || coalesce(exam_year, 0) AS paper_key, CASE coalesce(paper_id, '') WHEN '' THEN 'unknown' WHEN 'p1' THEN 'Computer test' WHEN 'p2' THEN 'Document' ELSE paper_id END AS extractor, 'file ' || id || '.pdf' AS base FROM n")
def x1_x2_x3_x4_names(spark, sf):
    code = F.when(F.col("paper_id") == "p1", " CBT ").when(F.col("paper_id") == "p2", "pdf").otherwise(F.col("paper_id"))
    path = F.concat(F.when(F.col("question_number") > 60, "C:\\dir\\").otherwise("/a/b/"), F.lit("file "), "id", F.lit(".pdf"))
    return meta(spark, sf).select("id", X.collapse("exam_name").alias("collapsed"), X.paper_key("exam_name", F.coalesce("exam_year", F.lit(0))).alias("paper_key"), X.coded(code, CODES).alias("extractor"), X.basename(path).alias("base"))


@query(f"WITH {META} SELECT id, upper(split_part(name, ' ', 1)) AS first, CASE WHEN contains(name, ' ') THEN regexp_replace(name, '^\\S+ ', '') ELSE name END AS exam_type, CASE WHEN name = '' THEN 'GENERAL' WHEN starts_with(name, 'TSPSC GROUP') THEN 'TSPSC GROUP' WHEN starts_with(name, 'SS') THEN 'SS' ELSE split_part(name, ' ', 1) END AS commission, array_to_string(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]{{2,}}'), lambda x: x NOT IN ('a', 'an', 'and', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with'))), ',') = '' AS no_tokens FROM n")
def x15_x16_x17_x18_commissions(spark, sf):
    return meta(spark, sf).select("id", X.first_token("exam_name").alias("first"), X.exam_type("exam_name").alias("exam_type"), X.commission("exam_name", ("tspsc group",), ("SS",)).alias("commission"), (F.size(X.tokens("question")) == 0).alias("no_tokens"))


@query(f"WITH {ATT}, g AS (SELECT uid, count(*) AS n, sum(is_correct::INT)::BIGINT AS r FROM a GROUP BY 1) SELECT uid, round_even(r * 100.0 / n, 1)::DOUBLE AS one_digit, floor(r * 100.0 / n + 0.5)::BIGINT AS half_up, round_even(r * 100.0 / n, 0)::DOUBLE AS half_even, greatest(3, ceil(n * 0.05))::BIGINT AS threshold, 0.0::DOUBLE AS of_none FROM g")
def x37_x38_x39_x40_percents(spark, sf):
    g = attempts(spark, sf).groupBy("uid").agg(F.count("*").alias("n"), F.sum(F.col("is_correct").cast("int")).alias("r"))
    return g.select("uid", X.percent("r", "n").alias("one_digit"), X.percent_half_up("r", "n").alias("half_up"), X.percent("r", "n", 0).alias("half_even"), X.structural_threshold("n").alias("threshold"), X.percent("r", F.lit(0)).alias("of_none"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE ELSE TIMESTAMP '2024-01-30 00:00:00' END::VARCHAR AS at FROM events")
def x44_times(spark, sf):
    n, iso = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(n % 4 == 0, F.concat(iso, F.lit("Z"))).when(n % 4 == 1, F.concat(iso, F.lit("+01:30"))).when(n % 4 == 2, "soon")
    return t(spark, sf, "events").select("event_id", F.date_format(X.timestamp_or(raw, AS_OF), "yyyy-MM-dd HH:mm:ss").alias("at"))


# every text with letters of two other scripts put in
_MIXED = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'क') WHEN 2 THEN replace(text, ' ', ' తె ') ELSE 'कख' END"
_STRIPPED = "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(x, '[\\x{0900}-\\x{097F}\\x{0C00}-\\x{0C7F}]', '', 'g'), '[ \\t]{2,}', ' ', 'g'), chr(10)), lambda s: regexp_replace(s, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda s: s <> ''), chr(10))"


@query(f"WITH m AS (SELECT doc_id, {_MIXED} AS x FROM documents), l AS (SELECT *, length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(x, '[^\\x{{0900}}-\\x{{097F}}\\x{{0C00}}-\\x{{0C7F}}]', '', 'g')) - length(regexp_replace(x, '[^\\x{{0C46}}]', '', 'g')) AS other FROM m) SELECT doc_id, CASE WHEN letters = 0 THEN 0 ELSE other / letters END AS ratio, {_STRIPPED} AS english, ((trim(x) <> '')::INT + (doc_id % 4 = 0)::INT)::INT AS filled FROM l")
def x7_x8_x9_regional(spark, sf):
    n, d = F.col("doc_id"), t(spark, sf, "documents")
    text = F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.replace("text", F.lit("e"), F.lit("क"))).when(n % 4 == 2, F.replace("text", F.lit(" "), F.lit(" తె "))).otherwise("कख")
    return d.select("doc_id", X.regional_ratio(text).alias("ratio"), X.strip_regional(text).alias("english"), X.filled(text, F.when(n % 4 == 0, "x").otherwise("  ")).cast("int").alias("filled"))


@query("WITH q AS (SELECT doc_id, source, doc_id % 10 = 0 AS gone, substr('ABCD', (doc_id % 4)::INT + 1, 1) AS a, CASE WHEN doc_id % 3 > 0 THEN substr('ABCD', (doc_id % 5 % 4)::INT + 1, 1) END AS s FROM documents WHERE doc_id % 10 <> 0), v AS (SELECT source AS subject, count(*) FILTER (coalesce(a = s, false)) AS correct, count(*) FILTER (s IS NOT NULL AND a <> s) AS wrong, count(*) FILTER (s IS NULL) AS skipped, count(*) AS total FROM q GROUP BY 1) SELECT *, CASE WHEN correct + wrong = 0 THEN 0 ELSE floor(correct * 100.0 / (correct + wrong) + 0.5) END::BIGINT AS accuracy, floor(correct * 100.0 / total + 0.5)::BIGINT AS score FROM v")
def a24_x35_x36_mock_result(spark, sf):
    n, d = F.col("doc_id"), t(spark, sf, "documents")
    letter = lambda k: F.substring(F.lit("ABCD"), (k % 4).cast("int") + 1, F.lit(1))
    questions = d.select(n.alias("question_id"), F.col("source").alias("subject"), F.array(letter(n)).alias("accepted"), (n % 10 == 0).alias("deleted"))
    return L.mock_result(questions, d.where("doc_id % 3 > 0").select(n.alias("question_id"), letter(n % 5).alias("selected")))
