"""Queries of the publish gate and the repair queue; `documents` serve as a question bank with exams and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import publishing as P
from ..operators import quality as Q
from .banks import _FILLED, _JOINED, _REGIONAL, BANK, _re, bank
from .queries import query, t


def exams(spark, sf):
    n = F.col("id")
    rows = bank(spark, sf).withColumn("exam_year", F.when(n % 12 < 9, n % 3 + 2020).otherwise(2019).cast("int"))
    return rows.withColumn("question_number", F.when(F.col("exam_year") == 2019, F.col("question_number")).otherwise(F.when(n % 41 > 0, F.floor(n / 60) % 40 + 1)).cast("int"))


def explanations(spark, sf):
    """Explanations that name letters and hold the text of options."""
    n = F.col("question_id")
    b = bank(spark, sf).where("id % 2 = 0").select(F.col("id").alias("question_id"), *Q.OPTIONS)
    return b.select("question_id", F.concat(F.when(n % 3 == 0, "The correct answer is B.").when(n % 3 == 1, F.concat(F.lit("Option C is right; see "), "option_a")).otherwise(F.concat(F.lit("answer: D, not "), "option_b"))).alias("explanation"))


ROWS = f"""{BANK}, e AS (SELECT * REPLACE (CASE WHEN id % 12 >= 9 THEN question_number WHEN id % 41 > 0 THEN ((id // 60) % 40 + 1)::INT END AS question_number), CASE WHEN id % 12 < 9 THEN (id % 3 + 2020)::INT ELSE 2019 END AS exam_year FROM q),
p AS (SELECT *, {_FILLED} AS filled, regexp_replace(question_text, '^\\s+|\\s+$', '', 'g') AS body, has_image OR coalesce(image_url, '') <> '' OR regexp_matches({_JOINED}, '{_re(Q.IMAGE)}') AS image FROM e),
b AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN length(body) < 15 THEN 'short-or-empty-text' END, CASE WHEN filled < 4 THEN CASE WHEN image THEN 'image-dependent-review' ELSE 'incomplete-options' END END,
CASE WHEN needs_review THEN 'answer-review' END, CASE WHEN correct_answer NOT IN ('A', 'B', 'C', 'D') THEN 'invalid-answer' END,
CASE WHEN filled = 4 AND len(regexp_extract_all(body, '{_re(Q.INLINE_OPTION)}')) >= 2 AND NOT regexp_matches(body, '{_re(Q.STATEMENTS)}') OR length(body) < 2 AND filled < 2 THEN 'broken-extraction' END,
CASE WHEN NOT regexp_matches(lower(exam_name), 'upsc|cisf|nda|cds') AND {_REGIONAL.format(x='(' + _JOINED + ')')} >= 0.12 THEN 'regional-script' END], lambda x: x IS NOT NULL))) AS base FROM p)"""
QUEUE = f"""{ROWS}, x AS (SELECT exam_name, exam_year, count(*) AS n, count(question_number) AS m, max(question_number) AS top FROM b GROUP BY 1, 2), j AS (SELECT *, m >= greatest(5, floor(n * 0.8)) AS judged FROM x),
r AS (SELECT b.id, b.exam_name, b.exam_year, b.question_number, b.is_active, list_sort(list_concat(base, list_filter([CASE WHEN judged AND question_number IS NULL THEN 'unnumbered-questions' END, CASE WHEN question_number IS NOT NULL AND count(question_number) OVER (PARTITION BY b.exam_name, b.exam_year, question_number) > 1 THEN 'duplicate-question-numbers' END], lambda y: y IS NOT NULL))) AS reasons FROM b JOIN j USING (exam_name, exam_year)),
c AS (SELECT *, CASE WHEN list_has_any(reasons, ['unnumbered-questions', 'duplicate-question-numbers']) THEN 'numbering/data repair' WHEN list_has_any(reasons, ['regional-script', 'short-or-empty-text', 'incomplete-options', 'broken-extraction']) THEN 'structural manual review' WHEN list_contains(reasons, 'image-dependent-review') THEN 'image/manual review' ELSE 'answer verification' END AS issue FROM r WHERE len(reasons) > 0),
w AS (SELECT id, exam_name, exam_year, question_number, issue, reasons, CASE WHEN issue IN ('structural manual review', 'image/manual review') THEN 'row' ELSE 'none' END AS blocker, CASE issue WHEN 'structural manual review' THEN 'P0' WHEN 'image/manual review' THEN 'P1' ELSE 'P3' END AS priority FROM c
UNION ALL SELECT NULL, exam_name, exam_year, k, 'numbering/data repair', ['missing-question-numbers'], 'none', 'P0' FROM (SELECT exam_name, exam_year, unnest(range(1, top + 1))::INT AS k FROM j WHERE judged) WHERE (exam_name, exam_year, k) NOT IN (SELECT exam_name, exam_year, question_number FROM b WHERE question_number IS NOT NULL))"""
ASSESSED = f"{QUEUE}, h AS (SELECT exam_name, exam_year, count(*) AS row_blockers FROM w WHERE blocker = 'row' GROUP BY 1, 2), a AS (SELECT exam_name, exam_year, n AS question_count, coalesce(row_blockers, 0) AS row_blockers, greatest(3, ceil(n * 0.05))::BIGINT AS threshold FROM x LEFT JOIN h USING (exam_name, exam_year))"


@query(f"WITH {ROWS} SELECT id, array_to_string(base, ',') AS reasons FROM b")
def c5_base_reasons(spark, sf):
    return exams(spark, sf).select("id", F.array_join(P.base_reasons(), ",").alias("reasons"))


@query(f"WITH {QUEUE} SELECT id, exam_name, exam_year, question_number, issue, blocker, priority, array_to_string(reasons, ',') AS reasons FROM w")
def c8_u4_repair_queue(spark, sf):
    return P.repair_queue(exams(spark, sf)).drop("severity").withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH {ASSESSED} SELECT exam_name, exam_year, question_count, row_blockers, row_blockers AS structural, threshold, row_blockers >= threshold AS reupload_needed, CASE WHEN row_blockers >= threshold THEN row_blockers ELSE 0 END AS paper_blockers, row_blockers < threshold AS publishable, row_blockers < threshold AND row_blockers > 0 AS with_hidden_rows, question_count - row_blockers AS visible_count FROM a")
def a12_assessment(spark, sf):
    rows = exams(spark, sf)
    return P.assessed(rows, P.repair_queue(rows))


def papers(spark, sf):
    """A paper for each source and year from 2017 to 2020, some of them replaced; 2017 and 2018 have no questions."""
    d = t(spark, sf, "documents").select(F.col("source").alias("exam_name")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    k = F.col("k")
    return d.select(F.concat("exam_name", F.lit("-"), k).alias("id"), "exam_name", (k % 4 + 2017).cast("int").alias("exam_year"), k.alias("upload_version"), F.when(k == 5, "replaced").alias("lifecycle_status"), F.when(k % 2 == 0, "reupload_needed").otherwise("blocked").alias("publish_status"), k.alias("question_count"), F.lit(0).alias("visible_question_count"), k.alias("hidden_question_count"))


_GATE = ASSESSED.replace("FROM q)", "FROM q WHERE is_active)")
_GATED = f"""{_GATE}, g AS (SELECT a.exam_name, a.exam_year, question_count, row_blockers < threshold AS publishable, row_blockers < threshold AND row_blockers > 0 AS with_hidden_rows, row_blockers >= threshold AS reupload_needed, question_count - row_blockers AS visible_count, row_blockers AS hidden_count,
coalesce((SELECT string_agg(DISTINCT z, ',' ORDER BY z) FROM (SELECT unnest(reasons) AS z FROM w WHERE w.exam_name = a.exam_name AND w.exam_year = a.exam_year AND blocker = 'row')), '') AS reasons,
coalesce((SELECT string_agg(s, ';' ORDER BY o) FROM (SELECT 'Q' || coalesce(question_number::VARCHAR, '?') || ':' || issue AS s, row_number() OVER (ORDER BY CASE issue WHEN 'structural manual review' THEN 2 ELSE 3 END, question_number NULLS LAST, id::VARCHAR) AS o FROM w WHERE w.exam_name = a.exam_name AND w.exam_year = a.exam_year AND blocker = 'row') WHERE o <= 20), '') AS samples FROM a),
l AS (SELECT source AS exam_name, (k % 4 + 2017)::INT AS exam_year, max(k) AS k FROM (SELECT DISTINCT source FROM documents), range(8) AS v(k) WHERE k <> 5 GROUP BY 1, 2),
reports AS (SELECT * FROM g UNION ALL SELECT exam_name, exam_year, k, false, false, k % 2 = 0, 0, k, 'no-active-questions', '' FROM l WHERE (exam_name, exam_year) NOT IN (SELECT exam_name, exam_year FROM g))"""


@query(f"WITH {_GATED} SELECT * FROM reports")
def a11_j23_u5_publish_gate(spark, sf):
    return P.gate(exams(spark, sf), papers(spark, sf)).withColumns({"reasons": F.array_join("reasons", ","), "samples": F.array_join("samples", ";")})


@query(f"WITH {_GATED} SELECT count(*) FILTER (publishable) AS publishable_exams, count(*) FILTER (NOT publishable) AS blocked_exams, count(*) FILTER (with_hidden_rows) AS with_hidden_rows, count(*) FILTER (reupload_needed) AS reupload_needed_exams FROM reports")
def a15_readiness(spark, sf):
    return P.readiness(P.gate(exams(spark, sf), papers(spark, sf)))


@query(f"WITH {QUEUE} SELECT id FROM b WHERE id NOT IN (SELECT id FROM w WHERE blocker = 'row')")
def n18_visible_ids(spark, sf):
    rows = exams(spark, sf)
    return P.visible_ids(rows, P.repair_queue(rows))


@query(f"WITH {QUEUE}, s AS (SELECT exam_name, exam_year, count(*) AS row_blockers FROM w WHERE blocker = 'row' GROUP BY 1, 2), z AS (SELECT exam_name, exam_year, count(*) AS queue_rows, count(*) FILTER (id IS NULL) AS gaps FROM w GROUP BY 1, 2), d AS (SELECT exam_name, exam_year, count(*) AS dup FROM (SELECT exam_name, exam_year, question_number FROM b WHERE question_number IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1, 2), m AS (SELECT exam_name, exam_year, count(DISTINCT question_number) FILTER (question_number > 0) AS have FROM b GROUP BY 1, 2) SELECT b.exam_name, b.exam_year, count(*) AS rows, count(question_number) AS numbered, coalesce(max(question_number), 0) AS max_seen, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (correct_answer NOT IN ('A', 'B', 'C', 'D')) AS invalid_answers, count(*) FILTER (subject IN ('General Knowledge', 'Unclassified', '')) AS generic_subjects, count(*) FILTER (topic IN ('General', 'Unclassified', '')) AS generic_topics, count(*) FILTER (coalesce(subtopic, '') = '') AS empty_subtopics, count(*) FILTER (id % 2 = 0) AS explained, greatest(0, coalesce(max(question_number), 0) - any_value(have)) AS missing_numbers, coalesce(any_value(dup), 0) AS duplicate_numbers, coalesce(any_value(queue_rows), 0) AS queue_rows, coalesce(any_value(row_blockers), 0) AS row_blockers, coalesce(any_value(row_blockers), 0) AS structural, greatest(3, ceil(count(*) * 0.05))::BIGINT AS threshold FROM b LEFT JOIN s USING (exam_name, exam_year) LEFT JOIN z USING (exam_name, exam_year) LEFT JOIN d USING (exam_name, exam_year) LEFT JOIN m USING (exam_name, exam_year) GROUP BY 1, 2")
def a14_exam_report(spark, sf):
    return P.exam_report(exams(spark, sf), explanations(spark, sf))


@query("SELECT k AS id, CASE WHEN k % 5 = 4 THEN 'publishable' WHEN k % 5 = 3 THEN 'mixed' WHEN k % 5 = 2 THEN 'extraction-structure-related' WHEN k % 5 = 1 THEN 'answer-related' ELSE CASE WHEN k % 2 = 0 AND k > 0 THEN 'image-dependent' ELSE 'answer-related' END END AS decision FROM (SELECT DISTINCT doc_id % 100 AS k FROM documents)")
def c9_decision(spark, sf):
    k = F.col("id")
    rows = t(spark, sf, "documents").select((F.col("doc_id") % 100).alias("id")).distinct()
    some = lambda *x: F.array(*map(F.lit, x))
    reasons = F.when(k % 5 == 4, F.array().cast("array<string>")).when(k % 5 == 3, some("invalid-answer", "regional-script")).when(k % 5 == 2, some("regional-script")).otherwise(some("invalid-answer"))
    images = F.when((k % 5 == 0) & (k % 2 == 0), k).otherwise(k + 1)
    return rows.select("id", P.decision(reasons, k, images).alias("decision"))


_TOLD = f"{BANK}, told AS (SELECT id AS question_id, CASE id % 3 WHEN 0 THEN 'The correct answer is B.' WHEN 1 THEN 'Option C is right; see ' || option_a ELSE 'answer: D, not ' || option_b END AS explanation FROM q WHERE id % 2 = 0)"


@query(f"WITH {_TOLD} SELECT id, correct_answer IN ('A', 'B', 'C', 'D') AND (id % 3 = 0 AND correct_answer <> 'B' OR id % 3 = 2 AND correct_answer <> 'D') AS implied, id % 3 = 0 AND correct_answer <> 'B' OR id % 3 = 1 AND correct_answer <> 'C' AS asserted FROM q JOIN told ON id = question_id")
def c21_c22_contradictions(spark, sf):
    rows = bank(spark, sf).join(explanations(spark, sf).drop(*Q.OPTIONS), F.col("id") == F.col("question_id"))
    return rows.select("id", P.implies_other("explanation", "correct_answer").alias("implied"), P.asserts_other("explanation", "correct_answer").alias("asserted"))


@query(f"WITH {_TOLD}, h AS (SELECT q.*, explanation, list_filter([CASE WHEN length(option_a) >= 3 AND contains(lower(explanation), lower(option_a)) THEN 'A' END, CASE WHEN length(option_b) >= 3 AND contains(lower(explanation), lower(option_b)) THEN 'B' END, CASE WHEN length(option_c) >= 3 AND contains(lower(explanation), lower(option_c)) THEN 'C' END, CASE WHEN length(option_d) >= 3 AND contains(lower(explanation), lower(option_d)) THEN 'D' END], lambda x: x IS NOT NULL) AS held FROM q JOIN told ON id = question_id WHERE is_active AND correct_answer IN ('A', 'B', 'C', 'D')) SELECT id AS question_id, correct_answer, held[1] AS explanation_implies, left(explanation, 240) AS explanation_excerpt FROM h WHERE len(held) = 1 AND held[1] <> correct_answer")
def c23_j7_mismatches(spark, sf):
    return P.mismatches(exams(spark, sf), explanations(spark, sf)).select("question_id", "correct_answer", "explanation_implies", "explanation_excerpt")


@query(f"WITH {ROWS}, v AS (SELECT *, correct_answer IN ('A', 'B', 'C', 'D') AND NOT needs_review AS ok FROM b WHERE is_active), c AS (SELECT exam_name, exam_year, count(*) AS total_questions, count(*) FILTER (ok) AS verified_answers, count(*) FILTER (NOT ok) AS missing_answers, count(*) FILTER (ok AND id % 2 = 0) AS explanations_generated FROM v GROUP BY 1, 2) SELECT *, round_even(verified_answers * 100.0 / total_questions, 1)::DOUBLE AS answer_coverage_pct, CASE WHEN verified_answers = 0 THEN 0 ELSE round_even(explanations_generated * 100.0 / verified_answers, 1) END::DOUBLE AS explanation_coverage_pct, missing_answers = 0 OR verified_answers > 0 AS has_answer_key, verified_answers = 0 AS needs_answer_key FROM c")
def a9_answer_coverage(spark, sf):
    return P.answer_coverage(exams(spark, sf), explanations(spark, sf))
