"""Queries of row quality, repairs and live operators over the driver's tables; `documents` serve as a question bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..streaming import live
from .queries import ORACLE_SQL, QUERIES, query, t

__all__ = ["ORACLE_SQL", "QUERIES", "bank"]

_WORD = "regexp_extract(text, '^(?:[a-zA-Z]+ ){{{k}}}([a-zA-Z]+)', 1)"
BANK = "q AS (SELECT doc_id AS id, text AS question_text, " + ", ".join(f"CASE WHEN doc_id % {m} = 0 THEN '' ELSE {_WORD.format(k=k)} END AS option_{c}" for k, (c, m) in enumerate(zip("abcd", (11, 13, 17, 19), strict=True))) + ", CASE WHEN doc_id % 23 > 0 THEN (doc_id % 90)::INT END AS question_number, source AS exam_name, CASE WHEN doc_id % 5 > 0 THEN lang ELSE 'General Knowledge' END AS subject, CASE WHEN doc_id % 7 > 0 THEN source ELSE 'general' END AS topic, CASE WHEN doc_id % 3 > 0 THEN lang END AS subtopic, substr('ABCDE', (doc_id % 5)::INT + 1, 1) AS correct_answer, CASE WHEN doc_id % 29 = 0 THEN 'deleted' END AS answer_status, doc_id % 8 = 0 AS needs_review, doc_id % 9 = 0 AS has_image, CASE WHEN doc_id % 18 = 0 THEN 'x.png' END AS image_url, CASE WHEN doc_id % 31 = 0 THEN 'stale' END AS explanation_status, doc_id % 37 <> 0 AS is_active FROM documents)"


def bank(spark: SparkSession, sf: str) -> DataFrame:
    """`documents` as question rows."""
    d, n = t(spark, sf, "documents"), F.col("doc_id")
    option = lambda k, m: F.when(n % m == 0, "").otherwise(F.regexp_extract("text", "^(?:[a-zA-Z]+ ){%d}([a-zA-Z]+)" % k, 1))
    return d.select(
        n.alias("id"), F.col("text").alias("question_text"), *(option(k, m).alias(c) for k, (c, m) in enumerate(zip(Q.OPTIONS, (11, 13, 17, 19), strict=True))), F.when(n % 23 > 0, (n % 90).cast("int")).alias("question_number"),
        F.col("source").alias("exam_name"), F.lit(None).cast("string").alias("question_type"), F.when(n % 5 > 0, F.col("lang")).otherwise("General Knowledge").alias("subject"), F.when(n % 7 > 0, F.col("source")).otherwise("general").alias("topic"), F.when(n % 3 > 0, F.col("lang")).alias("subtopic"),
        F.substring(F.lit("ABCDE"), (n % 5).cast("int") + 1, F.lit(1)).alias("correct_answer"), F.when(n % 29 == 0, "deleted").alias("answer_status"), (n % 8 == 0).alias("needs_review"), (n % 9 == 0).alias("has_image"), F.when(n % 18 == 0, "x.png").alias("image_url"), F.when(n % 31 == 0, "stale").alias("explanation_status"), (n % 37 != 0).alias("is_active"),
    )


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


_REGIONAL = "CASE WHEN length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) = 0 THEN 0 ELSE length(regexp_replace({x}, '[^\\x{{0900}}-\\x{{097F}}\\x{{0C00}}-\\x{{0C7F}}]', '', 'g')) * 1.0 / length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) END"
_JOINED = "question_text || ' ' || option_a || ' ' || option_b || ' ' || option_c || ' ' || option_d"
_FILLED = "((option_a <> '')::INT + (option_b <> '')::INT + (option_c <> '')::INT + (option_d <> '')::INT)"
_PENALTY = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in Q.PENALTY.items()) + "}"
_LIST = lambda labels: "[" + ", ".join(f"'{x}'" for x in labels) + "]"
CODES = f"""{BANK}, p AS (SELECT *, {_FILLED} AS filled, regexp_replace(question_text, '^\\s+|\\s+$', '', 'g') AS body, has_image OR coalesce(image_url, '') <> '' OR regexp_matches({_JOINED}, '{_re(Q.IMAGE)}') AS image FROM q),
f AS (SELECT *, has_image AND coalesce(image_url, '') <> '' AND filled = 4 AS fallback, CASE correct_answer WHEN 'A' THEN option_a WHEN 'B' THEN option_b WHEN 'C' THEN option_c ELSE option_d END AS given FROM p),
c AS (SELECT *, list_sort(list_filter([
CASE WHEN coalesce(question_number, 0) <= 0 THEN 'unnumbered-questions' END,
CASE WHEN length(body) < 15 AND NOT fallback THEN 'short-or-empty-text' END,
CASE WHEN filled < 4 THEN CASE WHEN image THEN 'image-dependent-review' ELSE 'incomplete-options' END END,
CASE WHEN filled = 4 AND len(regexp_extract_all(body, '{_re(Q.INLINE_OPTION)}')) >= 2 AND NOT regexp_matches(body, '{_re(Q.STATEMENTS)}') AND NOT fallback THEN 'broken-extraction' END,
CASE WHEN NOT regexp_matches(lower(exam_name), 'upsc|cisf|nda|cds') AND NOT fallback AND {_REGIONAL.format(x='(' + _JOINED + ')')} >= 0.12 THEN 'regional-script' END,
CASE WHEN needs_review THEN 'answer-review' END,
CASE WHEN answer_status IS NULL AND correct_answer NOT IN ('A', 'B', 'C', 'D') THEN 'invalid-answer' END,
CASE WHEN answer_status IS NULL AND correct_answer IN ('A', 'B', 'C', 'D') AND given = '' THEN 'answer-option-missing' END,
CASE WHEN lower(subject) IN ('', 'general knowledge', 'unclassified') THEN 'generic-subject-tag' END,
CASE WHEN lower(topic) IN ('', 'general', 'unclassified') THEN 'generic-topic-tag' END,
CASE WHEN coalesce(subtopic, '') = '' THEN 'missing-subtopic-tag' END], lambda x: x IS NOT NULL)) AS codes FROM f)"""
STATE = f"""{CODES}, s AS (SELECT *, list_filter(codes, lambda x: x IN {tuple(Q.STRUCTURAL)}) AS broken, list_has_any(codes, {_LIST(Q.ANSWER)}) AS bad, list_has_any(codes, {_LIST(Q.TAGGING[:2])}) AS generic FROM c)"""


@query(f"WITH {CODES} SELECT id, array_to_string(codes, ',') AS codes FROM c")
def c1_issue_codes(spark, sf):
    return bank(spark, sf).select("id", F.array_join(Q.issue_codes(), ",").alias("codes"))


@query(f"WITH {STATE} SELECT id, CASE WHEN len(broken) > 0 THEN 'broken' ELSE 'valid' END AS structural_status, CASE WHEN answer_status = 'deleted' THEN 'deleted' WHEN bad OR correct_answer NOT IN ('A', 'B', 'C', 'D') THEN 'invalid' WHEN needs_review THEN 'ai_inferred' ELSE 'verified' END AS answer_status, CASE WHEN explanation_status = 'stale' THEN 'stale' ELSE 'missing' END AS explanation_status, CASE WHEN generic THEN 'weak' WHEN list_contains(codes, 'missing-subtopic-tag') THEN 'partial' ELSE 'strong' END AS tagging_status, needs_review OR len(broken) > 0 OR bad OR generic AS review_required, greatest(0, 100 - coalesce(list_sum(list_transform(codes, lambda x: ({_PENALTY})[x])), 0) - CASE WHEN explanation_status = 'stale' THEN 12 ELSE 0 END)::INT AS confidence_score, CASE WHEN len(broken) > 0 THEN 'hidden_structural' WHEN bad THEN 'hidden_quality' WHEN NOT is_active THEN 'hidden_admin' ELSE 'visible' END AS public_visibility, coalesce(broken[1], codes[1]) AS primary_issue_code FROM s")
def c2_quality_state(spark, sf):
    return Q.with_quality(bank(spark, sf)).select("id", *Q.STATE[:-1])


@query(f"WITH {CODES} SELECT id, CASE WHEN list_contains(codes, 'unnumbered-questions') THEN 'P3' WHEN list_has_any(codes, {_LIST(Q.STRUCTURE_CLASS)}) THEN 'P0' WHEN list_contains(codes, 'image-dependent-review') THEN 'P1' ELSE 'P3' END AS priority, CASE WHEN list_contains(codes, 'unnumbered-questions') THEN 'numbering/data repair' WHEN list_has_any(codes, {_LIST(Q.STRUCTURE_CLASS)}) THEN 'structural manual review' WHEN list_contains(codes, 'image-dependent-review') THEN 'image/manual review' ELSE 'answer verification' END AS issue FROM c")
def c7_queue_class(spark, sf):
    return bank(spark, sf).select("id", Q.queue_class(Q.issue_codes()).alias("c")).select("id", "c.priority", "c.issue")


@query(f"WITH {STATE}, b AS (SELECT id, exam_name, CASE WHEN id % 6 > 0 THEN (2015 + id % 4)::INT ELSE 0 END AS exam_year, CASE WHEN id % 5 IN (1, 2) THEN 'Shift ' || (id % 5) ELSE 'NO_SHIFT' END AS shift_label, is_active AS active, len(broken) = 0 AND NOT bad AND is_active AS visible, id % 4 = 1 AS practice, needs_review AS review, len(broken) > 0 AS broken, id IN (SELECT doc_id FROM labels) AS explained FROM s) SELECT exam_name, exam_year, shift_label, count(*) AS question_count, sum(active::INT)::BIGINT AS active_count, sum(visible::INT)::BIGINT AS visible_count, sum((NOT visible)::INT)::BIGINT AS hidden_count, sum(practice::INT)::BIGINT AS practice_ready_count, sum(review::INT)::BIGINT AS needs_review_count, sum(broken::INT)::BIGINT AS structural_broken_count, sum(explained::INT)::BIGINT AS explanation_count, string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR) AS question_ids, sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)) AS question_id_hash FROM b GROUP BY 1, 2, 3")
def a27_baseline_audit(spark, sf):
    n = F.col("id")
    rows = Q.with_quality(bank(spark, sf)).withColumns({"exam_year": F.when(n % 6 > 0, (2015 + n % 4).cast("int")), "shift_label": F.when((n % 5).isin(1, 2), F.concat(F.lit("Shift "), n % 5)).when(n % 5 == 3, " "), "practice_ready": F.when(n % 4 < 3, n % 4 == 1)})
    return Q.baseline(rows, t(spark, sf, "labels").select(F.col("doc_id").alias("question_id"))).withColumn("question_ids", F.array_join("question_ids", "\n"))


_TEXT = "regexp_replace(question_text, '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {BANK}, p AS (SELECT *, {_TEXT} AS body, {_FILLED} AS filled, {_REGIONAL.format(x='(' + _JOINED + ')')} AS ratio FROM q) SELECT id, (filled * 250 + least(length(body), 240) + (question_number IS NOT NULL)::INT * 25 + (correct_answer IN ('A', 'B', 'C', 'D'))::INT * 20 + (NOT needs_review)::INT * 10 + least(40, length(regexp_replace(body, '[^A-Za-z]', '', 'g'))) - CASE WHEN ratio >= 0.35 THEN 1200 WHEN ratio >= 0.12 THEN 500 WHEN ratio >= 0.04 THEN 120 ELSE 0 END - CASE WHEN body <> '' AND (regexp_matches(body, '{_re(Q.INSTRUCTION)}') OR (filled < 2 AND regexp_matches(body, '{_re(Q.DIRECTIVE)}'))) THEN 1500 ELSE 0 END - (filled = 0)::INT * 120 - (length(body) < 15)::INT * 80)::BIGINT AS score FROM p")
def c10_extraction_score(spark, sf):
    return bank(spark, sf).select("id", Q.extraction_score().cast("long").alias("score"))


@query(f"WITH {BANK} SELECT id AS question_id, 'answer_correction' AS repair_type, 'C' AS correct_answer FROM q WHERE id % 4 = 0 AND correct_answer <> 'C'")
def c24_answer_repairs(spark, sf):
    rows = bank(spark, sf).withColumn("detected", F.when(F.col("id") % 4 == 0, " c) ")).withColumn("options", F.lit(None).cast("map<string,string>"))
    return Q.repairs(rows, "detected", "options").select("question_id", "repair_type", F.col("proposed_patch")["correct_answer"].alias("correct_answer"))


@query("SELECT user_id AS question_id, count(DISTINCT event_type) AS flags, count(DISTINCT event_type) >= 3 AS hidden FROM events GROUP BY 1")
def r6_flags(spark, sf):
    return Q.hidden_by_flags(t(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("event_type").alias("user_id")))


@query("")
def r2_rate_limit(spark, sf):
    """Requests of a client one second apart, so that its limit is met; each decision depends on earlier ones."""
    e = t(spark, sf, "events")
    at = F.timestamp_seconds(F.floor(F.col("event_id") / 4))
    return live.limited(e.select((F.col("user_id") % 3).cast("string").alias("client"), F.col("event_id").alias("request_id"), at.alias("at"), (F.col("user_id") % 3 == 0).alias("signed_in")))


@query("SELECT event_id, substr('ABCD', (event_id % 4)::INT + 1, 1) = coalesce(a, 'A') AS is_correct FROM events LEFT JOIN (SELECT doc_id, substr('ABCD', (doc_id % 4)::INT + 1, 1) AS a FROM documents) d ON doc_id = user_id")
def r3_correctness(spark, sf):
    given = F.substring(F.lit("ABCD"), (F.col("event_id") % 4).cast("int") + 1, F.lit(1))
    a = t(spark, sf, "events").select("event_id", F.col("user_id").alias("question_id"), given.alias("selected_answer"), (given == "A").alias("is_correct"))
    q = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring(F.lit("ABCD"), (F.col("doc_id") % 4).cast("int") + 1, F.lit(1)).alias("correct_answer"), F.lit(None).cast("array<string>").alias("correct_answers"))
    return live.with_correctness(a, q).select("event_id", "is_correct")
