"""Queries of the public read path; `events` serve as question rows, `orders` as papers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as G
from ..operators import identity as I
from .queries import query, t

EXAMS = ["UPSC CSE PRELIMS", "APPSC GROUP 2", "TSPSC GROUP 1 PRELIMS", "SSC CGL", "SSC", "APPSC  GROUP 2 ", ""]


def meta(spark, sf):
    """Question rows with gaps of every kind: names, years, numbers, papers, shifts, hashes, flags and times."""
    n, u = F.col("event_id"), F.col("user_id")
    return t(spark, sf, "events").select(
        F.concat(F.lit("q"), F.lpad(n.cast("string"), 9, "0")).alias("id"), F.element_at(F.array(*(F.lit(x) for x in EXAMS)), (u % 7 + 1).cast("int")).alias("exam_name"), F.when(u % 11 > 0, u % 5 + 2020).cast("int").alias("exam_year"),
        F.when(n % 13 > 0, F.when(n % 17 == 0, 0).otherwise(n % 120)).cast("int").alias("question_number"), F.when(u % 3 > 0, F.concat(F.lit("p"), u % 10)).alias("paper_id"),
        F.when(n % 4 == 0, F.concat(F.lit("Shift "), u % 2 + 1)).when(n % 4 == 1, " ").alias("shift_label"), F.when(n % 6 == 0, F.concat(F.lit("h"), n % 500)).alias("question_hash"),
        F.when(n % 8 > 0, n % 9 > 0).alias("is_active"), F.when(n % 10 == 0, "hidden_structural").when(n % 10 == 1, "hidden").when(n % 10 < 5, "visible").alias("public_visibility"), F.when(n % 5 > 0, n % 4 == 1).alias("practice_ready"),
        F.when(n % 21 == 0, "broken").when(n % 2 == 0, "valid").alias("structural_status"), F.when(n % 3 > 0, F.concat(F.lit("Subject "), n % 7)).otherwise("").alias("subject"), F.concat(F.lit("T"), n % 31).alias("topic"), F.when(n % 2 == 0, F.concat(F.lit("U"), n % 3)).alias("subtopic"),
        F.element_at(F.array(*(F.lit(x) for x in ("Easy", "Medium", "Hard", "Mixed"))), (n % 4 + 1).cast("int")).alias("difficulty"), F.when(n % 19 == 0, "ab").otherwise(F.concat("event_type", F.lit(" question "), n % 700)).alias("question"),
        F.col("ts").alias("created_at"), F.when(n % 3 == 0, F.col("ts")).alias("updated_at"), (n % 23 == 0).alias("needs_review"), F.substring(F.lit("ABCD"), (n % 4 + 1).cast("int"), F.lit(1)).alias("correct_answer"),
    ).withColumn("question_text", F.col("question"))


META = f"""q AS (SELECT 'q' || lpad(event_id::VARCHAR, 9, '0') AS id, [{', '.join(f"'{x}'" for x in EXAMS)}][user_id % 7 + 1] AS exam_name, CASE WHEN user_id % 11 > 0 THEN (user_id % 5 + 2020)::INT END AS exam_year,
CASE WHEN event_id % 13 > 0 THEN CASE WHEN event_id % 17 = 0 THEN 0 ELSE (event_id % 120)::INT END END AS question_number, CASE WHEN user_id % 3 > 0 THEN 'p' || (user_id % 10) END AS paper_id,
CASE event_id % 4 WHEN 0 THEN 'Shift ' || (user_id % 2 + 1) WHEN 1 THEN ' ' END AS shift_label, CASE WHEN event_id % 6 = 0 THEN 'h' || (event_id % 500) END AS question_hash, CASE WHEN event_id % 8 > 0 THEN event_id % 9 > 0 END AS is_active,
CASE WHEN event_id % 10 = 0 THEN 'hidden_structural' WHEN event_id % 10 = 1 THEN 'hidden' WHEN event_id % 10 < 5 THEN 'visible' END AS public_visibility, CASE WHEN event_id % 5 > 0 THEN event_id % 4 = 1 END AS practice_ready,
CASE WHEN event_id % 21 = 0 THEN 'broken' WHEN event_id % 2 = 0 THEN 'valid' END AS structural_status, CASE WHEN event_id % 3 > 0 THEN 'Subject ' || (event_id % 7) ELSE '' END AS subject, 'T' || (event_id % 31) AS topic, CASE WHEN event_id % 2 = 0 THEN 'U' || (event_id % 3) END AS subtopic,
['Easy', 'Medium', 'Hard', 'Mixed'][event_id % 4 + 1] AS difficulty, CASE WHEN event_id % 19 = 0 THEN 'ab' ELSE event_type || ' question ' || (event_id % 700) END AS question, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts END AS updated_at, event_id % 23 = 0 AS needs_review, substr('ABCD', (event_id % 4)::INT + 1, 1) AS correct_answer FROM events),
n AS (SELECT *, trim(regexp_replace(exam_name, '\\s+', ' ', 'g')) AS name, coalesce(trim(shift_label), '') AS shift, coalesce(question_number, 0) AS num FROM q),
k AS (SELECT *, CASE WHEN name <> '' AND exam_year IS NOT NULL AND num > 0 THEN concat_ws('|', coalesce(paper_id, 'NO_PAPER'), CASE shift WHEN '' THEN 'NO_SHIFT' ELSE shift END, name, exam_year, num) ELSE id END AS key FROM n)"""
LIVE_PAPERS = "live AS (SELECT 'p' || k AS id, CASE k % 3 WHEN 0 THEN 'draft' WHEN 1 THEN 'publishable' ELSE 'publishable_with_hidden_rows' END AS publish_status, CASE k WHEN 4 THEN 'replaced' WHEN 5 THEN 'archived' END AS lifecycle_status, 'SSC CGL' AS exam_name, (2020 + k % 5)::INT AS exam_year FROM range(10) AS x(k)), pub AS (SELECT * FROM live WHERE publish_status <> 'draft' AND lifecycle_status IS NULL)"


def papers(spark):
    k = F.col("id")
    return spark.range(10).select(F.concat(F.lit("p"), k).alias("id"), F.when(k % 3 == 0, "draft").when(k % 3 == 1, "publishable").otherwise("publishable_with_hidden_rows").alias("publish_status"), F.when(k == 4, "replaced").when(k == 5, "archived").alias("lifecycle_status"), F.lit("SSC CGL").alias("exam_name"), (k % 5 + 2020).cast("int").alias("exam_year"))


ACTIVE = "coalesce(is_active, true)"
NOT_HIDDEN = "coalesce(public_visibility <> 'hidden_structural', true)"
BROKEN = "(coalesce(structural_status = 'broken', false) OR coalesce(public_visibility = 'hidden_structural', false))"


@query(f"WITH {META} SELECT id, {ACTIVE} AS in_all, {NOT_HIDDEN} AND coalesce(practice_ready, false) AS in_practice, {NOT_HIDDEN} AND {ACTIVE} AS in_public, {BROKEN} AS broken, CASE WHEN public_visibility IS NULL THEN NOT {BROKEN} AND {ACTIVE} ELSE public_visibility = 'visible' END AS visible, {ACTIVE} AND {NOT_HIDDEN} AND length(question) >= 3 AS candidate FROM q")
def f3_f11_f12_f13_predicates(spark, sf):
    m = meta(spark, sf)
    return m.select("id", G.is_public(m, include_all=True).alias("in_all"), G.is_public(m, practice=True).alias("in_practice"), G.is_public(m).alias("in_public"), G.broken().alias("broken"), G.visible().alias("visible"), G.practice_candidate().alias("candidate"))


@query(f"WITH {META} SELECT id, subject, practice_ready FROM q WHERE {NOT_HIDDEN} AND CASE WHEN EXISTS (SELECT 1 FROM q WHERE practice_ready) THEN coalesce(practice_ready, false) ELSE {ACTIVE} END")
def f1_f2_f4_f10_public_rows(spark, sf):
    m = meta(spark, sf)
    return G.without_answers(G.supported(m.where(G.is_public(m, practice=G.practice_mode(m))), ["subject", "practice_ready", "correct_answer", "no_such_column"]))


@query(f"WITH {META}, {LIVE_PAPERS} SELECT id FROM q WHERE (paper_id IS NULL OR paper_id IN (SELECT id FROM pub)) AND (paper_id IS NOT NULL OR (exam_name, exam_year) NOT IN (SELECT exam_name, exam_year FROM pub) OR exam_year IS NULL)")
def f5_j21_selected_papers(spark, sf):
    p = G.public_papers(papers(spark))
    return G.without_legacy(G.in_papers(meta(spark, sf), p), p).select("id")


@query(f"WITH {META} SELECT id FROM q WHERE subject = 'Subject 4' AND topic = 'T4' AND difficulty = 'Easy' AND contains(lower(question || ' ' || subject || ' ' || topic || ' ' || coalesce(subtopic, '')), 'click question')")
def f6_f8_facets_and_search(spark, sf):
    return G.searched(G.facets(meta(spark, sf), subject="Subject 4", topic="T4", difficulty="Easy", shift_label=None), " Click Question ").select("id")


@query(f"WITH {META} SELECT count(*) AS rows, count(DISTINCT key) AS identities, count(DISTINCT key) FILTER (key LIKE '%|%') AS numbered FROM k")
def d1_identities(spark, sf):
    key = I.identity(meta(spark, sf))
    m = meta(spark, sf).select(key.alias("k"))
    return m.agg(F.count("*").alias("rows"), F.countDistinct("k").alias("identities"), F.countDistinct(F.when(F.col("k.kind") == "paper", F.col("k"))).alias("numbered"))


@query(f"WITH {META}, u AS (SELECT CASE WHEN name = 'SSC' AND exam_year = 2021 THEN 'id' || id WHEN shift <> '' OR paper_id IS NOT NULL THEN 'id' || id WHEN name <> '' AND exam_year IS NOT NULL AND num > 0 THEN concat_ws('|', name, exam_year, num) WHEN question_hash IS NOT NULL THEN 'hash' || question_hash ELSE 'id' || id END AS key, CASE WHEN name = 'SSC' AND exam_year = 2021 THEN 'row' WHEN shift <> '' OR paper_id IS NOT NULL THEN 'id' WHEN name <> '' AND exam_year IS NOT NULL AND num > 0 THEN 'exam' WHEN question_hash IS NOT NULL THEN 'hash' ELSE 'id' END AS kind FROM n) SELECT kind, count(*) AS rows, count(DISTINCT key) AS identities FROM u GROUP BY 1")
def d2_unscoped_identities(spark, sf):
    key = I.identity(meta(spark, sf), scoped=False, by_id=(("SSC", 2021),))
    return meta(spark, sf).select(key.alias("k")).groupBy("k.kind").agg(F.count("*").alias("rows"), F.countDistinct("k.key").alias("identities"))


@query(f"WITH {META} SELECT arg_min(id, (updated_at IS NULL, -epoch_us(updated_at), -epoch_us(created_at), id)) AS id FROM k GROUP BY key")
def d3_first_rows(spark, sf):
    return G.first_rows(meta(spark, sf)).select("id")


@query(f"WITH {META}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC NULLS LAST, created_at DESC, id) AS place FROM k) SELECT first(id ORDER BY place) AS id, first(subject ORDER BY place) FILTER (subject <> '') AS subject, first(subtopic ORDER BY place) FILTER (subtopic <> '') AS subtopic, first(question_hash ORDER BY place) FILTER (question_hash <> '') AS question_hash, bool_or(needs_review) AS needs_review FROM r GROUP BY key")
def d4_merged_rows(spark, sf):
    return G.unique_rows(meta(spark, sf)).select("id", "subject", "subtopic", "question_hash", "needs_review")


_FIRST = "u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY updated_at DESC NULLS LAST, created_at DESC, id) AS place FROM k), one AS (SELECT * FROM u WHERE place = 1)"


_FIRST_OF_TOPIC = _FIRST.replace("FROM k)", "FROM k WHERE topic = 'T3')")


@query(f"WITH {META}, {_FIRST} SELECT id, (SELECT count(*) FROM one) AS total, 65 < (SELECT count(*) FROM one) AS has_more, CASE WHEN 65 < (SELECT count(*) FROM one) THEN '65' END AS next_cursor FROM one ORDER BY name, coalesce(exam_year, 0) DESC, CASE num WHEN 0 THEN 1000000000 ELSE num END, id LIMIT 25 OFFSET 40")
def t1_t2_public_page(spark, sf):
    return G.public_page(G.unique_rows(meta(spark, sf)), G.exam_order(), 40, 25).select("id", "total", "has_more", "next_cursor")


@query(f"WITH {META}, {_FIRST_OF_TOPIC} SELECT id FROM one ORDER BY coalesce(exam_year, 0) DESC, exam_name, coalesce(question_number, 1000000000), id LIMIT 20")
def t4_t5_topic_page(spark, sf):
    return G.unique_rows(G.facets(meta(spark, sf), topic="T3")).orderBy(*G.topic_order()).limit(20).select("id")


@query("WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || (event_id % 50) || ' ' WHEN 1 THEN 'x1' WHEN 2 THEN NULL WHEN 3 THEN '-4' WHEN 4 THEN '+' || (event_id % 7) ELSE (event_id % 90)::VARCHAR END AS c FROM events) SELECT event_id, greatest(0, coalesce(TRY_CAST(trim(c) AS BIGINT), 0)) AS cursor, CASE WHEN regexp_matches(trim(c), '^-?[0-9]+$') THEN trim(c)::BIGINT ELSE 1000000000 END AS number FROM v")
def t3_t6_cursors_and_numbers(spark, sf):
    n = F.col("event_id")
    v = t(spark, sf, "events").select(n, F.when(n % 6 == 0, F.concat(F.lit(" "), n % 50, F.lit(" "))).when(n % 6 == 1, "x1").when(n % 6 == 3, "-4").when(n % 6 == 4, F.concat(F.lit("+"), n % 7)).when(n % 6 == 5, (n % 90).cast("string")).alias("c"))
    return v.select("event_id", G.cursor("c").alias("cursor"), G.safe_number("c").alias("number"))


@query(f"WITH {META} SELECT id, subject, difficulty FROM q WHERE subject = 'Subject 4' AND difficulty = 'Easy' ORDER BY md5('7:' || id), id LIMIT 10")
def t7_t8_v1_random_sample(spark, sf):
    """Ten rows drawn by a seed among those of one subject and difficulty."""
    return G.sampled(meta(spark, sf), 10, 7, subject="Subject 4", topic=None, difficulty="Easy").select("id", "subject", "difficulty")


@query("SELECT p_partkey, row_number() OVER (ORDER BY array_to_string(list_transform(regexp_extract_all(lower(p_name), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), ''), p_partkey) AS place FROM part WHERE p_size < 4")
def t11_natural_order(spark, sf):
    from ..operators.learner import ranked

    rows = t(spark, sf, "part").where("p_size < 4").withColumn("key", G.natural("p_name"))
    return ranked(rows, [F.asc("key"), F.asc("p_partkey")], "place").select("p_partkey", "place")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END AS place FROM customer")
def t12_listed_order(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", G.listed("c_mktsegment", ["MACHINERY", "BUILDING"]).alias("place"))


_PRACTICE = f"live AS (SELECT name AS e, exam_year AS y, max(paper_id) AS p FROM n WHERE name <> '' AND exam_year IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1, 2), c AS (SELECT n.*, p, {ACTIVE} AND {NOT_HIDDEN} AND length(question) >= 3 AS ok, CASE WHEN name <> '' AND exam_year > 0 AND num > 0 THEN concat_ws('|', CASE shift WHEN '' THEN 'exam' ELSE 'exam_shift' END, name, exam_year, nullif(shift, ''), num) WHEN question_hash IS NOT NULL THEN 'hash' || question_hash ELSE 'id' || id END AS pk FROM n LEFT JOIN live ON name = e AND exam_year = y)"


def _live(rows):
    from ..functions.text import collapse

    rows = rows.withColumn("exam_name", collapse("exam_name")).where("exam_name <> '' AND exam_year IS NOT NULL AND paper_id IS NOT NULL")
    return rows.groupBy("exam_name", "exam_year").agg(F.max("paper_id").alias("paper_id"))


@query(f"WITH {META}, {_PRACTICE} SELECT id, coalesce(practice_ready, false) AS was, ok AND row_number() OVER (PARTITION BY name, exam_year, pk, ok ORDER BY coalesce(paper_id = p, false) DESC, paper_id IS NOT NULL DESC, created_at DESC, id) = 1 AS target FROM c")
def d6_e1_practice_ready(spark, sf):
    m = meta(spark, sf)
    return G.practice_ready(m, _live(m))


@query(f"WITH {META}, {_PRACTICE}, a AS (SELECT *, CASE WHEN num > 0 THEN concat_ws('|', 'qnum', coalesce(paper_id, shift), num) ELSE id END AS ak FROM c) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY exam_name, exam_year, ak ORDER BY coalesce(paper_id = p, false) DESC, coalesce(structural_status = 'broken', false), coalesce(public_visibility = 'visible', false) DESC, created_at DESC, id DESC) AS place FROM a) WHERE place = 1")
def d7_n17_admin_rows(spark, sf):
    m = meta(spark, sf)
    return G.admin_rows(m, _live(m)).select("id")


@query("WITH g AS (SELECT user_id, list(event_id % 200 ORDER BY event_id) AS l FROM events GROUP BY 1), d AS (SELECT user_id, v, min(i) AS i FROM (SELECT user_id, unnest(l) AS v, unnest(range(len(l))) AS i FROM g) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS p FROM d) SELECT user_id, string_agg(v, ',' ORDER BY p) AS ids FROM r WHERE p <= 50 GROUP BY 1")
def d17_capped_ids(spark, sf):
    lists = t(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("l"))
    ids = G.capped_ids(F.transform("l", lambda x: x % 200))
    return lists.select("user_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {META}, v AS (SELECT *, upper(split_part(name, ' ', 1)) AS commission, CASE WHEN contains(name, ' ') THEN regexp_replace(name, '^\\S+ ', '') ELSE name END AS exam_type FROM n WHERE name <> '' AND coalesce(exam_year, 0) <> 0), y AS (SELECT commission, exam_type, exam_year, count(*) AS c FROM v GROUP BY 1, 2, 3), l AS (SELECT commission, exam_type, string_agg(exam_year, ',' ORDER BY exam_year DESC) AS years, string_agg(exam_year || ':' || c, ',' ORDER BY exam_year DESC) AS year_counts FROM y GROUP BY 1, 2) SELECT commission, exam_type, count(*) AS count, any_value(years) AS years, any_value(year_counts) AS year_counts, arg_min(trim(exam_name), id) AS full_name, count(*) FILTER (difficulty = 'Easy') AS easy, count(*) FILTER (difficulty = 'Medium') AS medium, count(*) FILTER (difficulty = 'Hard') AS hard FROM v JOIN l USING (commission, exam_type) GROUP BY 1, 2")
def a3_catalog(spark, sf):
    return G.catalog(meta(spark, sf))


@query(f"WITH {META}, v AS (SELECT exam_name, exam_year, CASE subject WHEN '' THEN 'General' ELSE subject END AS subject, topic, subtopic FROM q) SELECT exam_name, exam_year, subject, topic, subtopic, count(*) AS count FROM v GROUP BY GROUPING SETS ((exam_name, exam_year, subject), (exam_name, exam_year, subject, topic), (exam_name, exam_year, subject, topic, subtopic)) HAVING GROUPING(subtopic) = 1 OR subtopic IS NOT NULL")
def a6_exam_outline(spark, sf):
    return G.outline(meta(spark, sf))


@query(f"WITH {META}, c AS (SELECT subject, topic, subtopic, count(*) AS n FROM q GROUP BY 1, 2, 3), s AS (SELECT subject, sum(n)::BIGINT AS n FROM c GROUP BY 1), t AS (SELECT subject, topic, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2) SELECT subject, NULL AS topic, NULL AS subtopic, n, floor(n * 100.0 / sum(n) OVER () + 0.5)::BIGINT AS weight FROM s UNION ALL SELECT subject, topic, NULL, n, floor(n * 100.0 / sum(n) OVER (PARTITION BY subject) + 0.5)::BIGINT FROM t UNION ALL SELECT subject, topic, subtopic, n, floor(n * 100.0 / sum(n) OVER (PARTITION BY subject, topic) + 0.5)::BIGINT FROM c")
def a7_weightage_levels(spark, sf):
    return G.weightage(meta(spark, sf))


@query(f"WITH {META}, g AS (SELECT exam_name, exam_year, paper_id, nullif(shift, '') AS s, count(*) AS c, min(question_number) AS f, max(question_number) AS l FROM n GROUP BY 1, 2, 3, 4), o AS (SELECT *, coalesce(s, CASE WHEN paper_id IS NOT NULL AND count(s) OVER w = 1 THEN max(s) OVER w END) AS shift_label FROM g WINDOW w AS (PARTITION BY exam_name, exam_year, paper_id)) SELECT exam_name, exam_year, paper_id, shift_label, sum(c)::BIGINT AS question_count, min(f) AS first_question_number, max(l) AS last_question_number FROM o GROUP BY 1, 2, 3, 4")
def a8_manifest(spark, sf):
    return G.manifest(meta(spark, sf))


@query(f"WITH {META} SELECT upper(split_part(name, ' ', 1)) AS commission, count(*) AS questions, count(DISTINCT exam_name) AS exams, count(DISTINCT topic) AS topics, count(DISTINCT exam_year) AS years, count(DISTINCT paper_id) AS papers FROM n WHERE name <> '' GROUP BY 1")
def a31_a29_commission_totals(spark, sf):
    return G.commission_totals(meta(spark, sf))


@query(f"WITH {META} SELECT subject, count(*) AS count FROM q WHERE {ACTIVE} GROUP BY 1")
def a1_v1_active_subject_counts(spark, sf):
    return G.subject_counts(meta(spark, sf))


@query(f"WITH {META} SELECT count(*) AS total, count(*) FILTER (difficulty = 'Easy') AS easy, count(*) FILTER (difficulty = 'Medium') AS medium, count(*) FILTER (difficulty = 'Hard') AS hard, (SELECT string_agg(y, ',' ORDER BY y DESC) FROM (SELECT DISTINCT exam_year AS y FROM q WHERE {ACTIVE} AND exam_year > 0)) AS years, (SELECT string_agg(e, ',' ORDER BY e) FROM (SELECT DISTINCT name AS e FROM n WHERE {ACTIVE} AND name <> '')) AS exams FROM q WHERE {ACTIVE}")
def a2_question_stats(spark, sf):
    return G.stats(meta(spark, sf))


@query(f"WITH {META}, {LIVE_PAPERS} SELECT id FROM q WHERE {ACTIVE} AND paper_id IN (SELECT id FROM pub)")
def f17_f18_accessible(spark, sf):
    rows = meta(spark, sf)
    return G.accessible(rows.where(G.active()), G.public_papers(papers(spark)).select(F.col("id").alias("paper_id")), premium=False).select("id")
