"""Queries of the rules and jobs that keep the question store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import upkeep as U
from .banks import _FILLED, BANK, bank
from .catalogue import META, meta
from .queries import ATT, AS_OF, OK, attempts, query, t

TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_REGION = "coalesce(length(regexp_replace({x}, '[^\\x{{0900}}-\\x{{097F}}\\x{{0C00}}-\\x{{0C7F}}]', '', 'g')) * 1.0 / nullif(length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')), 0), 0)"


@query(f"WITH {BANK} SELECT id, CASE WHEN coalesce(question_number, 0) <= 0 THEN 'unnumbered-questions' END AS reason, length({TRIM.format('question_text')}) >= 15 AND {_FILLED} = 4 AS recoverable, length(question_text) < 40 AND NOT has_image AND NOT starts_with(question_text, '[') OR {_FILLED} < 2 AS low_quality, length(question_text) >= 100 AND regexp_matches(lower(question_text), '[bcdfghjklmnpqrstvwxyz]{{15,}}') AS scrambled FROM q")
def f14_f15_n3_n4_row_rules(spark, sf):
    return bank(spark, sf).withColumn("is_cancelled", F.lit(False)).select("id", U.publish_block().alias("reason"), U.recoverable().alias("recoverable"), U.low_quality().alias("low_quality"), U.scrambled("question_text").alias("scrambled"))


_SHORT = "CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN ' ' || upper(left(text, 1)) || ', ' || substr(text, 2, 1) || ' and' WHEN 2 THEN ' all of the above' || CASE WHEN length(text) % 2 = 0 THEN ' ' ELSE left(text, 1) END WHEN 3 THEN 'Only ' || length(text) % 6 || ' and 3' WHEN 4 THEN 'Both ' || left(text, 1) || ' and ' || right(text, 1) ELSE left(text, 1) END"


@query(f"SELECT doc_id, regexp_matches(regexp_replace({_SHORT}, '^\\s+|\\s+$', '', 'g'), '{U.FRAGMENT.replace('(?iU)', '(?i)')}') AS fragment FROM documents")
def f22_answer_fragments(spark, sf):
    n, d, text = F.col("doc_id"), t(spark, sf, "documents"), F.col("text")
    first, size = F.substring(text, 1, 1), F.length(text)
    short = F.when(n % 6 == 0, text).when(n % 6 == 1, F.concat(F.lit(" "), F.upper(first), F.lit(", "), F.substring(text, 2, 1), F.lit(" and"))).when(n % 6 == 2, F.concat(F.lit(" all of the above"), F.when(size % 2 == 0, " ").otherwise(first)))
    short = short.when(n % 6 == 3, F.concat(F.lit("Only "), (size % 6).cast("string"), F.lit(" and 3"))).when(n % 6 == 4, F.concat(F.lit("Both "), first, F.lit(" and "), F.right(text, F.lit(1)))).otherwise(first)
    return d.select("doc_id", U.answer_fragment(short).alias("fragment"))


@query(f"WITH {META}, g AS (SELECT exam_name, exam_year, count(*) AS c, count(*) FILTER (num > 0) AS m, max(question_number) AS top FROM n GROUP BY 1, 2) SELECT id FROM n JOIN g ON n.exam_name = g.exam_name AND n.exam_year IS NOT DISTINCT FROM g.exam_year WHERE num > 0 OR NOT (m >= 0.8 * c OR m >= 50 AND top >= 50 AND m >= 0.5 * c)")
def f23_numbered_only(spark, sf):
    return U.numbered_only(meta(spark, sf)).select("id")


@query("WITH d AS (SELECT doc_id, regexp_replace(lower(text), '\\s+', ' ', 'g') AS b FROM documents), v AS (SELECT doc_id, trim(b) AS b, trim(CASE doc_id % 4 WHEN 0 THEN left(b, 60) WHEN 1 THEN b WHEN 2 THEN replace(left(b, 60), ' ', '') ELSE left(b, 40) || ' zzzz' END) AS a FROM d) SELECT doc_id, a <> '' AND b <> '' AND a <> b AND length(b) >= length(a) + 30 AND (contains(b, a) OR contains(replace(b, ' ', ''), replace(a, ' ', '')) AND length(replace(b, ' ', '')) > length(replace(a, ' ', '')) + 40 OR least(length(a), length(b), 80) >= 30 AND left(a, least(length(a), length(b), 80)) = left(b, least(length(a), length(b), 80)) AND length(b) > length(a) + 40) AS truncated FROM v")
def d14_truncated(spark, sf):
    n, d = F.col("doc_id"), t(spark, sf, "documents")
    b = F.regexp_replace(F.lower("text"), r"(?U)\s+", " ")
    cut = F.when(n % 4 == 0, F.substring(b, 1, 60)).when(n % 4 == 1, b).when(n % 4 == 2, F.replace(F.substring(b, 1, 60), F.lit(" "), F.lit(""))).otherwise(F.concat(F.substring(b, 1, 40), F.lit(" zzzz")))
    return d.select("doc_id", U.truncated(cut, "text").alias("truncated"))


@query("SELECT event_id AS id, 'Which is right?' || CASE WHEN event_id % 3 = 0 THEN chr(10) || '1. A statement' ELSE '' END || CASE WHEN event_id % 2 = 0 THEN '' ELSE chr(10) || '(B) ' || event_type || 's' END AS stem, CASE event_id % 5 WHEN 0 THEN '[1,2]' WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '[{\"a\":1}]' WHEN 3 THEN NULL ELSE '[\"x\"]' END AS list FROM events")
def x14_x33_stems_and_lists(spark, sf):
    n, kind = F.col("event_id"), F.col("event_type")
    stem = F.concat(F.lit("Which is right?"), F.when(n % 3 == 0, "\n1. A statement").otherwise(""), F.when(n % 2 == 0, F.concat(F.lit("\n(A) "), F.upper(kind), F.lit("\n(B) other"))).otherwise(F.concat(F.lit("\n(B) "), kind, F.lit("s"))))
    raw = F.when(n % 5 == 0, "```json\n[1, 2]\n```").when(n % 5 == 1, F.concat(F.lit("Here: ["), n, F.lit("] done"))).when(n % 5 == 2, '{"n": 3, "questions": [{"a": 1}]}').when(n % 5 == 3, "no list [ here").otherwise('["x"]')
    return t(spark, sf, "events").select(n.alias("id"), U.without_options(stem, "event_type").alias("stem"), U.json_list(raw).alias("list"))


@query(f"WITH {BANK}, k AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'X' WHEN id % 10 = 1 THEN 'B/D' WHEN id % 10 < 6 THEN 'C' WHEN id % 10 = 6 THEN '?' END AS key FROM q) SELECT q.id, CASE WHEN key = 'B/D' THEN 'B' WHEN key = 'C' THEN 'C' ELSE correct_answer END AS correct_answer, CASE WHEN key = 'B/D' THEN 'B,D' END AS correct_answers, CASE key WHEN 'X' THEN 'deleted' WHEN 'B/D' THEN 'multiple' WHEN 'C' THEN 'verified' ELSE answer_status END AS answer_status, needs_review AND coalesce(key, '?') = '?' AS needs_review, coalesce(key IN ('X', 'B/D') OR key = 'C' AND correct_answer <> 'C', false) AS changed FROM q JOIN k ON q.id = k.id")
def e8_j15_injected_key(spark, sf):
    n = F.col("id")
    rows = bank(spark, sf).withColumn("exam_year", F.lit(2020)).withColumn("question_number", n.cast("int")).withColumn("correct_answers", F.lit(None).cast("array<string>"))
    key = rows.select("exam_name", "exam_year", "question_number", F.when(n % 10 == 0, "X").when(n % 10 == 1, "b/d").when(n % 10 < 6, "C").when(n % 10 == 6, "?").alias("answer")).where("answer IS NOT NULL")
    return U.key_injected(rows, key).select("id", "correct_answer", F.array_join("correct_answers", ",").alias("correct_answers"), "answer_status", "needs_review", "changed")


@query(f"WITH {META}, p AS (SELECT DISTINCT paper_id AS id, CASE WHEN paper_id IN ('p1', 'p4') THEN 'CBT' ELSE 'pdf' END AS kind FROM q WHERE paper_id IS NOT NULL) SELECT n.id, CASE WHEN kind = 'CBT' THEN 'extractor_type=cbt' ELSE 'shift_label' END AS source FROM n LEFT JOIN p ON p.id = paper_id WHERE needs_review AND (kind = 'CBT' OR shift <> '')")
def e10_f16_j14_promotable(spark, sf):
    rows = meta(spark, sf)
    papers = rows.where("paper_id IS NOT NULL").select(F.col("paper_id").alias("id")).distinct().withColumn("extractor_type", F.when(F.col("id").isin("p1", "p4"), "CBT").otherwise("pdf"))
    return U.promotable(rows, papers).select("id", "source")


_STORED = "s AS (SELECT event_id, 'h' || (event_id % 3000) AS question_hash, CASE WHEN event_id % 2 = 0 THEN 'E1' ELSE 'E2' END AS exam_name, 2020 AS exam_year, event_id % 3 = 0 AS needs_review, event_id % 5 > 0 AS is_active FROM events WHERE event_id % 4 < 2)"


@query(f"WITH {_STORED}, f AS (SELECT event_id, 'h' || event_id AS question_hash, CASE WHEN event_id % 7 < 4 THEN 'E1' ELSE 'E2' END AS exam_name FROM events), j AS (SELECT f.event_id, bool_or(s.exam_name <> f.exam_name) AS other, bool_or(s.exam_name = f.exam_name) AS same, bool_or(s.exam_name = f.exam_name AND NOT needs_review AND is_active) AS done FROM f LEFT JOIN s USING (question_hash) GROUP BY 1) SELECT event_id AS id, CASE WHEN done THEN 'locked' WHEN other THEN 'rehashed' WHEN same THEN 'update' ELSE 'insert' END AS action FROM j")
def d11_e6_upsert_actions(spark, sf):
    n, e = F.col("event_id"), t(spark, sf, "events")
    stored = e.where("event_id % 4 < 2").select(F.concat(F.lit("h"), n % 3000).alias("question_hash"), F.when(n % 2 == 0, "E1").otherwise("E2").alias("exam_name"), F.lit(2020).alias("exam_year"), (n % 3 == 0).alias("needs_review"), (n % 5 > 0).alias("is_active"))
    new = e.select(n.alias("id"), F.concat(F.lit("h"), n).alias("question_hash"), F.when(n % 7 < 4, "E1").otherwise("E2").alias("exam_name"), F.lit(2020).alias("exam_year"), F.col("event_type").alias("question_text"), *(F.lit(o).alias(o) for o in Q.OPTIONS))
    return U.upsert_actions(new, stored).select("id", "action")


@query(f"WITH {BANK}, s AS (SELECT id, 'stem of ' || id AS stem, CASE WHEN id % 3 = 0 THEN 'x' ELSE '' END AS a FROM q WHERE id % 2 = 0) SELECT q.id, CASE WHEN s.id IS NOT NULL AND option_a = '' THEN a ELSE option_a END AS option_a, CASE WHEN s.id IS NOT NULL AND length({TRIM.format('question_text')}) < 20 THEN stem ELSE question_text END = question_text AS same_stem, needs_review OR s.id IS NOT NULL AND ((CASE WHEN option_a = '' THEN a ELSE option_a END <> '')::INT + (option_b <> '')::INT + (option_c <> '')::INT + (option_d <> '')::INT) < 4 AS needs_review FROM q LEFT JOIN s ON q.id = s.id")
def n1_j16_filled_from_second(spark, sf):
    rows = bank(spark, sf).withColumn("question_type", F.lit("MCQ"))
    second = rows.where("id % 2 = 0").select("id", F.concat(F.lit("stem of "), "id").alias("question_text"), F.when(F.col("id") % 3 == 0, " x ").otherwise("").alias("option_a"), *(F.lit("").alias(o) for o in Q.OPTIONS[1:]))
    out = U.filled_from(rows, second, ["id"]).join(rows.select("id", F.col("question_text").alias("_q")), "id")
    return out.select("id", "option_a", (F.col("question_text") == F.col("_q")).alias("same_stem"), "needs_review")


@query("WITH g AS (SELECT DISTINCT source AS exam_name FROM documents), w AS (SELECT exam_name, k::INT AS question_number FROM g, range(1, 101) AS v(k)) SELECT exam_name, question_number, 'manual_repair_' || lower(exam_name) || '_2020_' || question_number AS question_hash FROM w WHERE (exam_name, question_number) NOT IN (SELECT source, (doc_id % 90)::INT FROM documents WHERE doc_id % 23 > 0)")
def n5_drafts(spark, sf):
    rows = bank(spark, sf).withColumn("exam_year", F.lit(2020))
    numbers = rows.select("exam_name", "exam_year").distinct().withColumn("question_number", F.explode(F.sequence(F.lit(1), F.lit(100))))
    return U.drafts(numbers, rows.where("question_number IS NOT NULL")).select("exam_name", "question_number", "question_hash")


_P = "p AS (SELECT o_orderkey AS id, 'E' || (o_custkey % 40) AS exam_name, year(o_orderdate)::INT AS exam_year, (o_orderkey % 7)::INT AS upload_version, CASE WHEN o_orderkey % 3 = 0 THEN 'ingested' ELSE 'processing' END AS lifecycle_status FROM orders)"


def _papers(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("E"), F.col("o_custkey") % 40).alias("exam_name"), F.year("o_orderdate").alias("exam_year"), (k % 7).cast("int").alias("upload_version"), F.when(k % 3 == 0, "ingested").otherwise("processing").alias("lifecycle_status"))


@query(f"WITH {_P}, l AS (SELECT exam_name, exam_year, arg_max(id, (upload_version, id)) AS old, max(upload_version) AS v FROM p GROUP BY 1, 2), u AS (SELECT DISTINCT -1 - c_custkey AS id, 'E' || (c_custkey % 45) AS exam_name, 1995 AS exam_year FROM customer), k AS (SELECT *, row_number() OVER t AS k, lag(id) OVER t AS before, lead(id) OVER t AS after FROM u WINDOW t AS (PARTITION BY exam_name, exam_year ORDER BY id)), m AS (SELECT id, exam_name, exam_year, (coalesce(v, 0) + k)::INT AS upload_version, CASE WHEN after IS NULL THEN 'processing' ELSE 'replaced' END AS lifecycle_status, coalesce(before, old) AS supersedes FROM k LEFT JOIN l USING (exam_name, exam_year)) SELECT id, exam_name, exam_year, upload_version, CASE WHEN id IN (SELECT supersedes FROM m WHERE supersedes IS NOT NULL) THEN 'replaced' ELSE lifecycle_status END AS lifecycle_status, NULL::BIGINT AS supersedes FROM p UNION ALL SELECT id, exam_name, exam_year, upload_version, lifecycle_status, supersedes FROM m")
def e3_w8_new_versions(spark, sf):
    uploads = t(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("id"), F.concat(F.lit("E"), F.col("c_custkey") % 45).alias("exam_name"), F.lit(1995).alias("exam_year")).distinct()
    return U.new_versions(_papers(spark, sf), uploads)


@query(f"WITH {_P}, l AS (SELECT exam_name, exam_year, arg_max(id, (upload_version, id)) AS latest FROM p GROUP BY 1, 2), r AS (SELECT l_orderkey AS k, l_linenumber AS n, 'E' || (l_suppkey % 50) AS exam_name, year(l_shipdate)::INT AS exam_year, CASE WHEN l_linenumber = 1 THEN l_partkey::VARCHAR END AS paper_id FROM lineitem) SELECT k, n, coalesce(paper_id, latest::VARCHAR) AS paper_id FROM r LEFT JOIN l USING (exam_name, exam_year)")
def e4_j11_attached(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.concat(F.lit("E"), F.col("l_suppkey") % 50).alias("exam_name"), F.year("l_shipdate").alias("exam_year"), F.when(F.col("l_linenumber") == 1, F.col("l_partkey").cast("string")).alias("paper_id"))
    return U.attached(rows, _papers(spark, sf).withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0"))).select("k", "n", F.regexp_replace("paper_id", "^0+(?=.)", "").alias("paper_id"))


@query("SELECT doc_id AS id, 'enable' AS change FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 = 0 UNION ALL SELECT doc_id, 'disable' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0")
def e7_u2_toggles(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 4 != 0).alias("is_active"))
    return U.toggles(d.where("id % 3 = 0"), d)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'Fin' ELSE o_orderstatus END AS name, o_custkey % 9 <> 0 AND o_orderkey % 2 = 0 AS is_active FROM orders WHERE o_orderkey % 10 <> 3")
def s12_s13_s15_edited_rows(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), (F.col("o_orderkey") % 2 == 0).alias("is_active"), "o_custkey")
    gone = t(spark, sf, "orders").where("o_orderkey % 10 = 3").select(F.col("o_orderkey").alias("id"))
    return U.cascaded(U.renamed(U.soft_deleted(o, F.col("o_custkey") % 9 == 0), "F", "Fin", "name"), gone, "id").drop("o_custkey")


@query("SELECT event_id AS id, CASE WHEN event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 MINUTE THEN 'failed' WHEN event_type = 'click' THEN 'processing' WHEN event_type = 'view' THEN 'queued' ELSE event_type END AS status FROM events")
def e12_failed_jobs(spark, sf):
    kind = F.col("event_type")
    jobs = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(kind == "click", "processing").when(kind == "view", "queued").otherwise(kind).alias("status"), F.col("ts").alias("at"))
    return U.failed_jobs(jobs, "2024-01-15", 30).select("id", "status")


@query("SELECT doc_id AS id, 'old' AS src FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 0) UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 97 = 0")
def n8_replaced(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return U.replaced(d.withColumn("src", F.lit("old")), d.where("id % 97 = 0").withColumn("src", F.lit("new")), ["source"]).select("id", "src")


@query(f"WITH {META}, a AS (SELECT id, min(event_id) AS place FROM q JOIN events ON id = 'q' || lpad((event_id * 7 % 900)::VARCHAR, 9, '0') GROUP BY 1), f AS (SELECT id FROM (SELECT 'q' || lpad((event_id * 7 % 900)::VARCHAR, 9, '0') AS id, min(event_id) AS place FROM events GROUP BY 1 ORDER BY 2 LIMIT 300)) SELECT id, correct_answer FROM q WHERE id IN (SELECT id FROM f) AND coalesce(is_active, true)")
def n19_s4_revealed(spark, sf):
    n = F.col("event_id")
    ids = t(spark, sf, "events").select(F.concat(F.lit("q"), F.lpad((n * 7 % 900).cast("string"), 9, "0")).alias("id"), n.alias("place"))
    return U.revealed(meta(spark, sf), ids)


@query("SELECT user_id AS question_id, count(*) AS flags, max(ts) AS latest, left(any_value(text), 20) AS head FROM events JOIN documents ON doc_id = user_id GROUP BY 1 HAVING count(*) >= 3")
def a35_j5_flagged(spark, sf):
    flags = t(spark, sf, "events").select(F.col("user_id").alias("question_id"), F.col("ts").alias("at"))
    return U.flagged(flags, t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 20).alias("head")), 3)


@query("SELECT user_id AS question_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE count(*) END AS flags FROM events GROUP BY user_id")
def e11_resolved_flags(spark, sf):
    flags = t(spark, sf, "events").select(F.col("user_id").alias("question_id"))
    return U.resolved(flags, flags.where("question_id % 3 = 0").distinct())


@query("WITH p AS (SELECT 'Exam ' || (o_custkey % 30) AS name, year(o_orderdate)::INT AS y, (o_orderkey % 90)::BIGINT AS visible, (o_orderkey % 50)::BIGINT AS total, (o_orderkey % 7)::INT AS v FROM orders WHERE o_orderkey % 4 <> 0), k AS (SELECT name, y, max((visible, total, v)) AS r FROM p GROUP BY 1, 2), a AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN ' exam  ' || (c_custkey % 40) WHEN 1 THEN 'Exam' ELSE 'Exam ' || (c_custkey % 40) || ' Shift' END AS asked, 1995 AS exam_year FROM customer), m AS (SELECT asked, exam_year, name, r, lower(trim(regexp_replace(asked, '\\s+', ' ', 'g'))) AS x FROM a LEFT JOIN k ON y = exam_year AND (contains(lower(name), lower(trim(regexp_replace(asked, '\\s+', ' ', 'g')))) OR contains(lower(trim(regexp_replace(asked, '\\s+', ' ', 'g'))), lower(name)))) SELECT asked, exam_year, coalesce(name, trim(regexp_replace(asked, '\\s+', ' ', 'g'))) AS exam_name FROM (SELECT *, row_number() OVER (PARTITION BY asked, exam_year ORDER BY coalesce(lower(name) = x, false) DESC, r DESC NULLS LAST, name) AS place FROM m) WHERE place = 1")
def j17_resolved_names(spark, sf):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    papers = t(spark, sf, "orders").select(F.concat(F.lit("Exam "), F.col("o_custkey") % 30).alias("exam_name"), F.year("o_orderdate").alias("exam_year"), (k % 90).alias("visible"), (k % 50).alias("total"), (k % 7).cast("int").alias("upload_version"), F.when(k % 4 == 0, "archived").alias("lifecycle_status"))
    asked = t(spark, sf, "customer").select(F.when(c % 3 == 0, F.concat(F.lit(" exam  "), c % 40)).when(c % 3 == 1, "Exam").otherwise(F.concat(F.lit("Exam "), c % 40, F.lit(" Shift"))).alias("asked"), F.lit(1995).alias("exam_year"))
    return U.resolved_name(asked, papers)


@query(f"WITH {META} SELECT exam_name, coalesce(exam_year, 0) AS exam_year, count(*) AS total, count(*) FILTER (coalesce(is_active, false)) AS active, count(*) FILTER (NOT coalesce(is_active, false)) AS inactive, count(*) FILTER (NOT coalesce(is_active, false) AND length(question) >= 15 AND event % 2 = 0) AS inactive_usable, count(*) FILTER (structural_status = 'broken') AS broken, count(*) FILTER (coalesce(public_visibility, '') <> 'visible' AND length(question) >= 15 AND event % 2 = 0) AS hidden_visible_text FROM (SELECT *, substr(id, 2)::INT AS event FROM q) GROUP BY 1, 2")
def a28_missing_public(spark, sf):
    even = F.substring("id", 2, 9).cast("int") % 2 == 0
    rows = meta(spark, sf).withColumns({o: F.when(even & F.lit(o in ("option_a", "option_c")), "x").otherwise(" ") for o in Q.OPTIONS})
    return U.missing_public(rows)


@query(f"WITH {META}, v AS (SELECT CASE WHEN difficulty IN ('Easy', 'Hard') THEN difficulty ELSE 'Medium' END AS d, regexp_matches(lower(subject || ' ' || topic || ' ' || question), 'current|recent|latest|2024|2025|2026') AS c FROM q), s AS (SELECT count(*) AS total, count(*) FILTER (d = 'Easy') AS easy, count(*) FILTER (d = 'Medium') AS medium, count(*) FILTER (d = 'Hard') AS hard, count(*) FILTER (c) AS current, count(*) FILTER (NOT c) AS static FROM v) SELECT *, floor(easy * 100.0 / total + 0.5)::BIGINT AS easy_percent, floor(medium * 100.0 / total + 0.5)::BIGINT AS medium_percent, floor(hard * 100.0 / total + 0.5)::BIGINT AS hard_percent, floor(current * 100.0 / total + 0.5)::BIGINT AS current_percent, floor(static * 100.0 / total + 0.5)::BIGINT AS static_percent FROM s")
def a26_exam_analytics(spark, sf):
    return U.exam_analytics(meta(spark, sf))


@query("SELECT event_id, round(value, 2) AS cost, (SELECT count(*) FROM events WHERE event_type <> 'view') AS total_cost FROM events")
def s14_a38_cost_log(spark, sf):
    runs = t(spark, sf, "events").select("event_id", F.round("value", 2).alias("shown"), F.lit(1.0).alias("cost"), (F.col("event_type") == "view").alias("cached"))
    return U.cost_log(runs).select("event_id", F.col("shown").alias("cost"), F.col("total_cost").cast("long").alias("total_cost"))


@query(f"WITH {BANK} SELECT exam_name, count(*) AS rows, avg((id % 3 = 0)::INT) AS quality FROM q GROUP BY 1")
def a37_parse_quality(spark, sf):
    return U.parse_quality(bank(spark, sf), F.col("id") % 3 == 0, ["exam_name"])


@query(f"WITH {ATT}, s AS (SELECT uid, subject, {OK} AS correct, count(*) AS total FROM a GROUP BY 1, 2) SELECT uid, bucket, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, floor(sum(correct) * 100.0 / sum(total) + 0.5)::BIGINT AS accuracy FROM (SELECT *, 'low' AS bucket FROM s WHERE subject IN ('S0', 'S1') UNION ALL SELECT *, 'high' FROM s WHERE subject IN ('S1', 'S6')) GROUP BY 1, 2")
def a32_keyword_accuracy(spark, sf):
    from ..operators import learner as L

    return U.keyword_accuracy(L.by_subject(attempts(spark, sf)), {"low": ["s0", "s1"], "high": ["s6", "s1"]})


@query(f"WITH {ATT}, v AS (SELECT uid, CASE WHEN attempt_id % 4 > 0 THEN is_correct END AS c, attempt_id % 5 = 0 AS i FROM a), s AS (SELECT uid, count(*) FILTER (c AND NOT i) AS right, count(*) FILTER (NOT c AND NOT i) AS wrong FROM v GROUP BY 1) SELECT uid, \"right\", wrong, \"right\" + wrong AS answered, CASE WHEN \"right\" + wrong = 0 THEN 0 ELSE floor(\"right\" * 100.0 / (\"right\" + wrong) + 0.5) END::BIGINT AS accuracy, \"right\" * 10 + wrong * 2 AS xp FROM s".replace("AS right,", 'AS "right",'))
def a25_session_stats(spark, sf):
    n = F.col("attempt_id")
    return U.session_stats(attempts(spark, sf).select("uid", F.when(n % 4 > 0, F.col("is_correct")).alias("correct"), (n % 5 == 0).alias("ignored")), ["uid"])


@query(f"WITH {ATT}, s AS (SELECT uid, attempt_id % 300 AS question_id, max(at)::DATE AS due_date FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY due_date, question_id) AS place FROM s WHERE due_date <= DATE '{AS_OF}') SELECT uid, question_id, due_date, place, lang FROM r JOIN documents ON doc_id = question_id WHERE place <= 20")
def j1_j3_j4_due_reviews(spark, sf):
    s = attempts(spark, sf).groupBy("uid", (F.col("attempt_id") % 300).alias("question_id")).agg(F.to_date(F.max("at")).alias("due_date"))
    return U.due_reviews(s, t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), AS_OF)


@query(f"WITH {BANK}, v AS (SELECT id % 2 = 0 AS told, NOT needs_review AND correct_answer <> 'E' AS e FROM q) SELECT *, round_even(explained * 100.0 / total, 1)::DOUBLE AS coverage, round_even(eligible_explained * 100.0 / eligible, 1)::DOUBLE AS eligible_coverage FROM (SELECT count(*) AS total, count(*) FILTER (told) AS explained, count(*) FILTER (e) AS eligible, count(*) FILTER (told AND e) AS eligible_explained FROM v)")
def a10_eligible_coverage(spark, sf):
    rows = bank(spark, sf)
    return U.coverage_of(rows, rows.where("id % 2 = 0").select(F.col("id").alias("question_id")), ~F.col("needs_review") & (F.col("correct_answer") != "E"))


@query("SELECT p_partkey, p_size * 72 AS seconds FROM part")
def x46_exam_seconds(spark, sf):
    return t(spark, sf, "part").select("p_partkey", U.exam_seconds("p_size").alias("seconds"))

