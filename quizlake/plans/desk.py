"""Queries of the editors' desk: states, labels, edits, papers, files, lists and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk as D
from ..operators import quality as Q
from ..sources import snapshots as S
from .banks import BANK, STATE, bank
from .catalogue import META, meta, papers
from .publishing import QUEUE, _TOLD, exams, explanations
from .queries import AS_OF, query, t
from .taxonomy import quoted

_SHORT, _LACKING = "length(trim(question_text, ' ')) < 15", "(option_a = '' OR option_b = '' OR option_c = '' OR option_d = '')"
_WRONG, _VAGUE = "correct_answer NOT IN ('A', 'B', 'C', 'D')", "(coalesce(subject, '') IN ('', 'Unclassified', 'General Knowledge') OR coalesce(topic, '') IN ('', 'Unclassified', 'General'))"


def _explained(spark, sf):
    return t(spark, sf, "labels").select(F.col("doc_id").alias("question_id"))


@query(f"""WITH {BANK}, s AS (SELECT *, {_SHORT} AS short, {_LACKING} AS lacking, {_WRONG} AS wrong, {_VAGUE} AS vague FROM q) SELECT id, CASE WHEN short OR lacking THEN 'broken' ELSE 'valid' END AS structural_status, CASE WHEN wrong THEN 'invalid' WHEN needs_review THEN 'ai_inferred' ELSE 'verified' END AS answer_status,
CASE WHEN EXISTS (SELECT 1 FROM labels WHERE doc_id = s.id) THEN 'generated' ELSE 'missing' END AS explanation_status, CASE WHEN vague THEN 'weak' WHEN coalesce(subtopic, '') = '' THEN 'partial' ELSE 'strong' END AS tagging_status, NOT is_active OR short OR lacking OR wrong OR needs_review OR vague AS review_required,
greatest(0, 100 - 35 * short::INT - 35 * lacking::INT - 30 * wrong::INT - 8 * needs_review::INT - 8 * (coalesce(subject, '') IN ('', 'Unclassified', 'General Knowledge'))::INT - 6 * (coalesce(topic, '') IN ('', 'Unclassified', 'General'))::INT - 3 * (coalesce(subtopic, '') = '')::INT)::INT AS confidence_score,
CASE WHEN NOT is_active THEN 'hidden_admin' WHEN short OR lacking THEN 'hidden_structural' ELSE 'visible' END AS public_visibility, CASE WHEN short THEN 'short-or-empty-text' WHEN lacking THEN 'incomplete-options' WHEN needs_review THEN 'answer-review' WHEN wrong THEN 'invalid-answer' END AS primary_issue_code FROM s""")
def c4_j10_stored_state(spark, sf):
    return D.stored_state(bank(spark, sf), _explained(spark, sf)).select("id", *Q.STATE[:-1])


@query(f"WITH {META}, h AS (SELECT exam_name, exam_year, max('f' || id) AS f, count(*) AS n, count(*) FILTER (is_active) AS v, count(*) FILTER (NOT is_active) AS hid FROM q GROUP BY 1, 2), j AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'SSC' ELSE 'Job  ' || (c_custkey % 5) END AS exam_name, (2019 + c_custkey % 4)::INT AS exam_year, max('j' || c_custkey) AS f, 0 AS n, 0 AS v, 0 AS hid FROM customer GROUP BY 1, 2), g AS (SELECT * FROM h UNION ALL SELECT * FROM j WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.exam_name = j.exam_name AND h.exam_year IS NOT DISTINCT FROM j.exam_year)) SELECT exam_name, exam_year, lower(regexp_replace(exam_name, '\\s+', ' ', 'g')) || '::' || exam_year AS paper_key, f AS source_filename, CASE WHEN n > 0 THEN 'ingested' ELSE 'pending' END AS lifecycle_status, CASE WHEN hid > 0 THEN 'publishable_with_hidden_rows' WHEN n > 0 THEN 'publishable' ELSE 'draft' END AS publish_status, n AS question_count, v AS visible_question_count, hid AS hidden_question_count FROM g WHERE NOT (exam_name = 'SSC CGL' AND coalesce(exam_year, 0) BETWEEN 2020 AND 2024)")
def a30_first_papers(spark, sf):
    n = F.col("c_custkey")
    jobs = t(spark, sf, "customer").select(F.when(n % 3 == 0, "SSC").otherwise(F.concat(F.lit("Job  "), n % 5)).alias("exam_name"), (n % 4 + 2019).cast("int").alias("exam_year"), F.concat(F.lit("j"), n).alias("filename"), F.lit(AS_OF).cast("timestamp").alias("created_at"))
    rows = meta(spark, sf).withColumn("source_pdf", F.concat(F.lit("f"), "id"))
    return D.bootstrapped(rows, jobs, papers(spark).withColumn("upload_version", F.lit(1))).drop("display_name", "upload_version", "structural_issue_count", "created_at")


_LABELS = [["Polity", "general", "", "Economy", "Art"], ["River basins", "Basics", "Laws of motion", "Budget  (old) state specific", "Ashokan edicts", "Causes", "mixed", "Gupta"], ["", "Parliament today", "Budget (old) facts", "rajya", "Time, speed", "overview", "Ratio"]]
_PICK = [f"[{', '.join(map(quoted, v))}][event_id * {k} % {len(v)} + 1]" for v, k in zip(_LABELS, (1, 3, 5), strict=True)]
_BUCKET = lambda x, other: f"CASE WHEN lower(trim({x})) IN ('', 'general', 'unclassified', 'miscellaneous', 'basics', 'mixed') THEN {other} ELSE trim({x}) END"
_FIRST = lambda x, rules, other: "CASE " + " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN {quoted(v)}" for p, v in rules) + f" ELSE {other} END"
_BITS = " OR ".join(f"contains(u, {quoted(b)})" for b in D.GENERIC_BITS)


@query(f"WITH l AS (SELECT event_id, {_PICK[0]} AS subject, {_PICK[1]} AS topic, {_PICK[2]} AS subtopic FROM events), a AS (SELECT *, {_BUCKET('topic', quoted('General'))} AS c FROM l), b AS (SELECT *, {_BUCKET('subtopic', 'c')} AS s FROM a), d AS (SELECT *, lower(subject || ' ' || topic || ' ' || subtopic) AS x, lower(subject || ' ' || c || ' ' || s) AS y, lower(c) AS v, lower(s) AS u FROM b) SELECT event_id, {_FIRST('x', D.CLIENT_SUBJECTS, _BUCKET('subject', quoted('General Knowledge')))} AS subject, {_FIRST('y', D.CLIENT_CONCEPTS, f'''CASE WHEN u = v OR starts_with(u, v) OR starts_with(v, u) OR {_BITS} THEN c ELSE trim(regexp_replace(regexp_replace(regexp_replace(c, '[[:space:]]+', ' ', 'g'), ' *[(][^)]*[)] *', ' ', 'g'), 'state specific', 'State Specific', 'gi')) END''')} AS concept FROM d", reserved=False)
def c16_client_taxonomy(spark, sf):
    subject, topic, subtopic = (F.element_at(F.array(*map(F.lit, v)), (F.col("event_id") * k % len(v) + 1).cast("int")) for v, k in zip(_LABELS, (1, 3, 5), strict=True))
    return t(spark, sf, "events").select("event_id", D.client_subject(subject, topic, subtopic).alias("subject"), D.client_concept(subject, topic, subtopic).alias("concept"))


_LIST = lambda x: "(" + ", ".join(map(quoted, x)) + ")"
_ALL = "question_text || ' ' || option_a || ' ' || option_b || ' ' || option_c || ' ' || option_d || ' ' || coalesce(subject, '') || ' ' || coalesce(topic, '') || ' ' || coalesce(subtopic, '')"
_ODD = " OR ".join(f"regexp_matches({_ALL}, {quoted('(?i)' + p)}) AND subject NOT IN {_LIST(s)}" for p, s in D.BELONGS)


def _labelled(spark, sf):
    n = F.col("id")
    return bank(spark, sf).withColumns({"subject": F.when(n % 4 == 0, "General Science").when(n % 4 == 1, "Polity").when(n % 4 == 2, "Environment").otherwise("Economy"), "topic": F.when(n % 6 == 0, "Matching").when(n % 6 == 1, "Laws of motion").when(n % 6 == 2, "The tax court").when(n % 6 == 3, "Tribes")})


_LABELLED = f"{BANK}, l AS (SELECT * REPLACE (CASE id % 4 WHEN 0 THEN 'General Science' WHEN 1 THEN 'Polity' WHEN 2 THEN 'Environment' ELSE 'Economy' END AS subject, CASE id % 6 WHEN 0 THEN 'Matching' WHEN 1 THEN 'Laws of motion' WHEN 2 THEN 'The tax court' WHEN 3 THEN 'Tribes' END AS topic) FROM q)"


@query(f"WITH {_LABELLED} SELECT id, {_ODD} AS suspect, coalesce(topic = 'Matching', false) AS vague, CASE WHEN is_active AND id % 4 = 0 THEN 'Science & Technology' WHEN is_active AND id % 4 = 2 THEN 'Environment & Ecology' ELSE subject END AS subject FROM l")
def c29_f24_f25_labels(spark, sf):
    rows = _labelled(spark, sf).withColumns({"suspect": D.suspect(), "vague": D.vague_topic()})
    return D.renamed_subjects(rows).select("id", "suspect", "vague", "subject")


@query(f"WITH {META} SELECT id FROM q WHERE is_active AND contains(lower(exam_name), 'group') AND exam_year = 2022 AND num % 3 > 0 ORDER BY practice_ready DESC NULLS FIRST, num % 50 DESC, id LIMIT 60".replace("FROM q WHERE is_active", "FROM (SELECT *, substr(id, 2)::INT AS num FROM q) WHERE is_active"))
def f26_tag_candidates(spark, sf):
    n = F.substring("id", 2, 9).cast("int")
    rows = meta(spark, sf).withColumns({"pattern_tag": F.when(n % 3 == 0, "x").otherwise(""), "confidence_score": n % 50, "pattern_tagged_at": F.lit(None).cast("timestamp")})
    return D.tag_candidates(rows, 60, exam="Group", year=2022, since=AS_OF).select("id")


@query("")
def n12_retagged(spark, sf):
    """Every rule of the taxonomy and of row quality at once; both have queries with SQL of their own."""
    return D.retagged(bank(spark, sf), _explained(spark, sf)).select("id", "subject", "topic", "subtopic", "confidence_score", "public_visibility")


_EDITED = STATE.replace("substr('ABCDE', (doc_id % 5)::INT + 1, 1) AS correct_answer", "CASE WHEN doc_id % 10 < 2 THEN 'C' ELSE substr('ABCDE', (doc_id % 5)::INT + 1, 1) END AS correct_answer").replace("doc_id % 8 = 0 AS needs_review", "doc_id % 8 = 0 AND doc_id % 10 > 0 AS needs_review")


@query(f"WITH {_EDITED}, d AS (SELECT *, is_active AND NOT needs_review AND length(body) >= 15 AND filled = 4 AND (correct_answer IN ('A', 'B', 'C', 'D') OR coalesce(answer_status = 'deleted', false)) AS done FROM s WHERE id % 10 < 3) SELECT id, correct_answer, CASE WHEN done OR NOT (len(broken) > 0 OR bad OR NOT is_active) THEN 'visible' WHEN len(broken) > 0 THEN 'hidden_structural' WHEN bad THEN 'hidden_quality' ELSE 'hidden_admin' END AS public_visibility, NOT done AND (needs_review OR len(broken) > 0 OR bad OR generic) AS review_required, id % 2 = 0 AND id % 10 >= 2 AS explained FROM d")
def n9_edited_rows(spark, sf):
    n = F.col("id")
    patch = F.when(n % 10 == 0, F.create_map(*map(F.lit, ("correct_answer", "C", "needs_review", "false")))).when(n % 10 == 1, F.create_map(F.lit("correct_answer"), F.lit("C"))).otherwise(F.create_map(F.lit("topic"), F.col("topic")))
    rows = bank(spark, sf)
    told = rows.where("id % 2 = 0").select(F.col("id").alias("question_id"))
    new, left = D.edited(rows, rows.where("id % 10 < 3").select("id", patch.alias("patch")), told)
    return new.join(left.select(F.col("question_id").alias("id"), F.lit(True).alias("explained")), "id", "left").select("id", "correct_answer", "public_visibility", "review_required", F.coalesce("explained", F.lit(False)).alias("explained"))


@query("SELECT o_orderkey AS id, 2024 AS exam_year, 'manual_1706572800_' || coalesce(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 90) END, 1) AS question_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'Option A' ELSE 'x' END AS option_a, 'Medium' AS difficulty, true AS needs_review, 'weak' AS tagging_status FROM orders")
def n10_manual_rows(spark, sf):
    n = F.col("o_orderkey")
    asked = t(spark, sf, "orders").select(n.cast("string").alias("exam_name"), F.lit(None).cast("int").alias("exam_year"), F.when(n % 5 > 0, (n % 90).cast("int")).alias("question_number"), F.when(n % 2 == 0, "").otherwise("x").alias("option_a"), F.lit(None).cast("boolean").alias("needs_review"))
    return D.manual_rows(asked, AS_OF).select(F.col("exam_name").cast("long").alias("id"), "exam_year", "question_hash", "option_a", "difficulty", "needs_review", "tagging_status")


@query(f"WITH {BANK} SELECT id AS question_id FROM q WHERE needs_review AND id % 2 = 0 AND exam_name = 'src8'")
def n11_stale_explanations(spark, sf):
    return D.stale_explanations(bank(spark, sf), explanations(spark, sf), "src8").select("question_id")


@query("WITH b AS (SELECT user_id AS uid, event_type AS question_id, value::VARCHAR AS note, ts, event_id FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY uid, question_id ORDER BY ts DESC, note) AS n FROM b WHERE event_id % 3 = 1), o AS (SELECT DISTINCT uid, question_id, 'old' AS note FROM b WHERE event_id % 3 = 0), m AS (SELECT uid, question_id, note FROM w WHERE n = 1 UNION ALL SELECT * FROM o WHERE (uid, question_id) NOT IN (SELECT uid, question_id FROM w)) SELECT * FROM m WHERE (uid, question_id) NOT IN (SELECT uid, question_id FROM b WHERE event_id % 30 = 2)")
def n13_bookmarks(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("question_id"), F.format_string("%s", "value").alias("note"), F.col("ts").alias("at"), "event_id")
    stored = e.where("event_id % 3 = 0").select("uid", "question_id", F.lit("old").alias("note"), F.lit(None).cast("timestamp").alias("at")).distinct()
    return D.bookmarked(stored, e.where("event_id % 3 = 1").drop("event_id"), e.where("event_id % 30 = 2")).select("uid", "question_id", "note")


@query("WITH s AS (SELECT user_id AS uid, arg_max('s' || event_id, (ts, 's' || event_id)) AS stats FROM events WHERE event_id % 2 = 0 AND user_id % 3 > 0 GROUP BY 1), u AS (SELECT DISTINCT user_id AS uid FROM events WHERE user_id % 2 = 0) SELECT coalesce(s.uid, u.uid) AS uid, coalesce(stats, 'old') AS stats, CASE WHEN s.uid IS NULL THEN '2020-01-01' ELSE '2024-01-30' END AS day FROM s FULL JOIN u USING (uid)")
def n14_v2_saved_stats(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("uid"), F.concat(F.lit("s"), "event_id").alias("stats"), F.col("ts").alias("at"), "event_id")
    stored = e.where("uid % 2 = 0").select("uid", F.lit("old").alias("stats"), F.lit("2020-01-01").cast("timestamp").alias("updated_at")).distinct()
    return D.stats_saved(stored, e.where("event_id % 2 = 0 AND uid % 3 > 0").drop("event_id"), AS_OF).select("uid", "stats", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))


@query(f"WITH {META} SELECT id, exam_name, exam_year, subject, topic, subtopic, difficulty, needs_review, is_active, paper_id, question_number FROM q WHERE is_active")
def n15_n16_admin_meta(spark, sf):
    rows = D.admin_meta(meta(spark, sf))
    return D.known_columns(rows.withColumn("unknown", F.lit(1)), rows)


@query("WITH b AS (SELECT o_custkey % 50 AS k, o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 90)::INT END AS num FROM orders), m AS (SELECT k, id, num, 0 AS late FROM b WHERE id % 3 > 0 UNION ALL SELECT k, id, num, 1 FROM b WHERE id % 3 = 0) SELECT k AS exam_key, id, row_number() OVER (PARTITION BY k ORDER BY coalesce(num, 9999), late, id) AS place FROM m")
def n7_merged_chunks(spark, sf):
    n = F.col("o_orderkey")
    rows = t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("exam_key"), n.alias("id"), F.when(n % 7 > 0, (n % 90).cast("int")).alias("question_number"), n.alias("position"))
    return D.chunk_merged(rows.where("id % 3 > 0"), rows.where("id % 3 < 2")).select("exam_key", "id", "place")


@query(f"WITH {META} SELECT id FROM q ORDER BY question_number NULLS LAST, created_at, id LIMIT 40 OFFSET 80")
def t9_admin_page(spark, sf):
    return D.admin_page(meta(spark, sf), page=3, page_size=40).select("id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'added' END AS change FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 > 0 OR doc_id % 3 > 0 AND doc_id % 4 = 0")
def u3_id_changes(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return D.id_changes(d.where("id % 12 % 3 = 0"), d.where("id % 4 = 0"))


_CARD = "SELECT DISTINCT user_id AS uid, event_type AS question_id FROM events"


@query(f"WITH c AS ({_CARD}), s AS (SELECT *, (uid % 9 + 1)::INT AS i, 1.3 + (uid % 7) / 5.0 AS e, (uid % 4)::INT AS r FROM c WHERE uid % 2 = 0), v AS (SELECT c.uid, c.question_id, (c.uid % 6)::INT AS q, coalesce(i, 1) AS i, coalesce(e, 2.5)::DOUBLE AS e, coalesce(r, 0) AS r FROM c LEFT JOIN s ON s.uid = c.uid AND s.question_id = c.question_id WHERE c.uid % 5 > 0), w AS (SELECT *, greatest(1.3, e + 0.1 - (5 - q) * (0.08 + (5 - q) * 0.02))::DOUBLE AS g FROM v), n AS (SELECT uid, question_id, CASE WHEN q < 3 OR r = 0 THEN 1 WHEN r = 1 THEN 6 ELSE round_even(i * g, 0) END::INT AS interval_days, CASE WHEN q < 3 THEN greatest(1.3, e - 0.2) ELSE round_even(g, 3) END::DOUBLE AS ease, CASE WHEN q < 3 THEN 0 ELSE r + 1 END::INT AS repetitions FROM w) SELECT * FROM n UNION ALL SELECT uid, question_id, i, e, r FROM s WHERE uid % 5 = 0")
def r5_reviewed_cards(spark, sf):
    c = t(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("question_id")).distinct()
    day = F.lit(AS_OF).cast("date")
    stored = c.where("uid % 2 = 0").select("uid", "question_id", (F.col("uid") % 9 + 1).cast("int").alias("interval_days"), (F.col("uid") % 7 / 5.0 + 1.3).alias("ease"), (F.col("uid") % 4).cast("int").alias("repetitions"), day.alias("due_date"), F.lit(0).alias("last_quality"))
    reviews = c.where("uid % 5 > 0").select("uid", "question_id", (F.col("uid") % 6).cast("int").alias("quality"), day.alias("on"))
    return D.reviewed(stored, reviews).select("uid", "question_id", "interval_days", "ease", "repetitions")


@query("WITH g AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS v, count(*) FILTER (l_returnflag = 'R') AS s FROM lineitem WHERE l_orderkey % 4 > 0 GROUP BY 1) SELECT o_orderkey AS id, coalesce(n, 0) AS question_count, coalesce(v, 0) AS visible_question_count, coalesce(n - v, 0) AS hidden_question_count, CASE WHEN coalesce(v, 0) = 0 THEN 'blocked' WHEN s >= greatest(3, ceil(n * 0.05)) THEN 'reupload_needed' WHEN s > 0 THEN 'publishable_with_hidden_rows' ELSE 'publishable' END AS publish_status, CASE WHEN n > 0 THEN 'ingested' ELSE 'processing' END AS lifecycle_status FROM orders LEFT JOIN g ON g.id = o_orderkey")
def e2_synced_papers(spark, sf):
    rows = t(spark, sf, "lineitem").where("l_orderkey % 4 > 0").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_linestatus") == "O").alias("visible"), (F.col("l_returnflag") == "R").alias("structural"))
    return D.synced(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(7).alias("question_count"), F.lit("x").alias("publish_status")), rows).select("id", "question_count", "visible_question_count", "hidden_question_count", "publish_status", "lifecycle_status")


@query(f"WITH {QUEUE}, k AS (SELECT exam_name, exam_year, count(*) AS hid FROM w WHERE blocker = 'row' GROUP BY 1, 2), n AS (SELECT exam_name, exam_year, count(*) AS question_count, count(*) FILTER (is_active) AS live, count(*) FILTER (is_active AND id NOT IN (SELECT id FROM w WHERE blocker = 'row')) AS visible_question_count FROM b GROUP BY 1, 2), v AS (SELECT n.*, coalesce(hid, 0) AS hidden_question_count, CASE WHEN coalesce(hid, 0) >= greatest(3, ceil(live * 0.05)) THEN 'reupload_needed' WHEN live = 0 THEN 'blocked' WHEN hid > 0 THEN 'publishable_with_hidden_rows' ELSE 'publishable' END AS publish_status FROM n LEFT JOIN k USING (exam_name, exam_year)) SELECT exam_name, exam_year, question_count, visible_question_count, hidden_question_count, publish_status, starts_with(publish_status, 'publishable') AS published FROM v")
def e5_published(spark, sf):
    return D.published(exams(spark, sf))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 AND o_orderkey % 5 > 0 AND o_orderstatus <> 'P' THEN CASE WHEN o_custkey % 3 = 0 THEN 'true:' || (o_custkey % 30) ELSE 'false:0' END END AS report FROM orders")
def j13_job_reports(spark, sf):
    n, k = F.col("o_orderkey"), F.col("o_custkey") % 30
    jobs = t(spark, sf, "orders").select(n.alias("id"), F.when(n % 4 > 0, F.concat(F.lit("E"), k)).otherwise("").alias("exam_name"), F.when(n % 5 > 0, 2020).alias("exam_year"), F.when(F.col("o_orderstatus") == "P", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"))
    reports = spark.range(30).where("id % 3 = 0").select(F.concat(F.lit("E"), "id").alias("exam_name"), F.lit(2020).alias("exam_year"), F.lit(True).alias("publishable"), F.col("id").alias("question_count"), F.array(F.lit("r")).alias("reasons"))
    r = F.col("quality_report")
    return D.with_reports(jobs, reports).select("id", F.when(r.isNotNull(), F.concat_ws(":", r["publishable"].cast("string"), r["question_count"].cast("string"))).alias("report"))


_TOKENS = lambda x: f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]{{2,}}'), lambda w: w NOT IN {_LIST(D.FILE_STOP)}))"
_HINTS = "list_filter([" + ", ".join(f"CASE WHEN contains(lower(exam_name), {quoted(p)}) AND ({' OR '.join(f'contains(lower(stem), {quoted(h)})' for h in hints)}) THEN 1 END" for p, hints in D.FILE_HINTS.items()) + "], lambda z: z IS NOT NULL)"


@query(f"WITH x AS (SELECT DISTINCT p_brand || CASE p_size % 3 WHEN 0 THEN ' CISF Group 4' WHEN 1 THEN ' Group 2' ELSE ' Prelims' END AS exam_name, CASE WHEN p_size % 4 > 0 THEN (2018 + p_size % 4)::INT END AS exam_year, CASE WHEN p_size % 2 = 0 THEN 'a/' || split_part(p_type, ' ', 1) || '.pdf' END AS source_pdf FROM part), f AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'gp_iv' WHEN 1 THEN 'cisf' WHEN 2 THEN split_part(p_type, ' ', 1) ELSE p_brand END || '-' || (2016 + p_size % 6) AS stem FROM part), s AS (SELECT *, greatest(len(list_intersect({_TOKENS('stem')}, {_TOKENS("exam_name || ' ' || coalesce(exam_year::VARCHAR, '')")})), len(list_intersect({_TOKENS('stem')}, {_TOKENS("coalesce(regexp_replace(split_part(source_pdf, '/', 2), '[.]pdf$', ''), '') || ' ' || coalesce(exam_year::VARCHAR, '')")}))) * 10 + CASE WHEN contains(stem, exam_year::VARCHAR) THEN 8 ELSE 0 END + 25 * len({_HINTS}) AS score FROM x, f), r AS (SELECT *, row_number() OVER (PARTITION BY exam_name, exam_year, source_pdf ORDER BY score DESC, length(stem), stem) AS n FROM s) SELECT exam_name, exam_year, source_pdf, stem || '.pdf' AS name, score::INT AS score FROM r WHERE n = 1 AND score >= 18", reserved=False)
def j18_matched_files(spark, sf):
    n, kind = F.col("p_size"), F.split_part("p_type", F.lit(" "), F.lit(1))
    p = t(spark, sf, "part")
    exams = p.select(F.concat("p_brand", F.when(n % 3 == 0, " CISF Group 4").when(n % 3 == 1, " Group 2").otherwise(" Prelims")).alias("exam_name"), F.when(n % 4 > 0, n % 4 + 2018).cast("int").alias("exam_year"), F.when(n % 2 == 0, F.concat(F.lit("a/"), kind, F.lit(".pdf"))).alias("source_pdf"))
    files = p.select(F.concat(F.when(n % 4 == 0, "gp_iv").when(n % 4 == 1, "cisf").when(n % 4 == 2, kind).otherwise(F.col("p_brand")), F.lit("-"), (n % 6 + 2016).cast("string"), F.lit(".pdf")).alias("name"))
    return D.matched_files(exams, files)


@query("WITH e AS (SELECT 'C' || (c_custkey % 3) AS commission, 'Type ' || (c_custkey % 40) AS exam_type, any_value(c_custkey % 40) AS k, list_distinct(list(2015 + c_custkey % 7)) AS ys FROM customer GROUP BY 1, 2) SELECT exam_type, row_number() OVER (ORDER BY k % 4 = 0, k) AS place FROM e WHERE commission = 'C1' AND (contains(lower(exam_type), 'type 1') OR contains('full name ' || k, 'type 1'))")
def f9_commission_exams(spark, sf):
    k = F.col("c_custkey") % 40
    e = t(spark, sf, "customer").groupBy(F.concat(F.lit("C"), F.col("c_custkey") % 3).alias("commission"), k.alias("k")).agg(F.collect_set((F.col("c_custkey") % 7 + 2015).cast("string")).alias("years"))
    e = e.select("commission", F.concat(F.lit("Type "), "k").alias("exam_type"), F.concat(F.lit("Full name "), "k").alias("full_name"), "years", (F.col("k") % 4 == 0).alias("locked"))
    return D.commission_exams(e, "C1", " TYPE 1 ").select("exam_type", "place")


@query(f"WITH {META} SELECT id, CASE WHEN event_no % 50 = 0 THEN 'a' WHEN event_no % 50 = 1 THEN 'What is this?' ELSE question_text END AS question_text FROM (SELECT id, question AS question_text, substr(id, 2)::INT AS event_no, public_visibility FROM q) WHERE coalesce(public_visibility <> 'hidden_structural', true) AND NOT (event_no % 50 = 0 AND event_no % 100 = 0)")
def f19_sanitised_rows(spark, sf):
    n = F.substring("id", 2, 9).cast("int")
    text = F.when(n % 50 == 0, "a").when(n % 50 == 1, "What is कख this?").otherwise(F.col("question_text"))
    rows = meta(spark, sf).withColumn("question_text", text).withColumns({o: F.when((n % 100 > 0) & (F.lit(i) < 2), "x").otherwise("") for i, o in enumerate(Q.OPTIONS)})
    return D.sanitised(rows).select("id", "question_text")


@query(f"WITH {_TOLD} SELECT q.id, CASE WHEN answer_status = 'deleted' THEN 'deleted-question' WHEN q.id % 7 = 0 THEN 'multiple-correct-answers' WHEN question_id IS NULL THEN 'unavailable-error' WHEN correct_answer IN ('A', 'B', 'C', 'D') AND (q.id % 3 = 0 AND correct_answer <> 'B' OR q.id % 3 = 2 AND correct_answer <> 'D') THEN 'hidden-contradiction' END AS source FROM q LEFT JOIN told ON q.id = question_id")
def c30_explanation_sources(spark, sf):
    rows = bank(spark, sf).join(explanations(spark, sf).withColumnRenamed("question_id", "id"), "id", "left").withColumn("correct_answers", F.when(F.col("id") % 7 == 0, F.array(F.lit("A"), F.lit("B"))))
    return rows.select("id", D.explanation_source("explanation", D.implies_other("explanation", "correct_answer")).alias("source"))


@query(f"WITH {_TOLD}, a AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id > 10 ORDER BY 1 LIMIT 50) SELECT question_id FROM told JOIN q ON q.id = question_id WHERE q.id IN (SELECT id FROM a) AND NOT (q.id % 4 = 2 AND NOT needs_review) AND NOT (correct_answer IN ('A', 'B', 'C', 'D') AND (q.id % 3 = 0 AND correct_answer <> 'B' OR q.id % 3 = 2 AND correct_answer <> 'D'))")
def c30_safe_explanations(spark, sf):
    told = explanations(spark, sf).withColumn("source", F.when(F.col("question_id") % 4 == 2, "ai, unverified-answer"))
    ids = bank(spark, sf).where("id > 10").select("id", F.col("id").alias("place"))
    return D.safe_explanations(bank(spark, sf), told, ids).select("question_id")


@query("SELECT event_id, user_id FROM events UNION ALL (SELECT event_id, NULL FROM events WHERE event_id = 7)")
def s1_s2_s3_scans(spark, sf):
    rows = S.scan(spark, f"{sf}/events.parquet", ["event_id", "user_id", "no_such_column"])
    return rows.unionByName(S.lookup(rows, 7, "event_id").withColumn("user_id", F.lit(None).cast("long")))


