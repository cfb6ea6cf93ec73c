
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import identity as I
from ..operators import learner as L

AS_OF = "2024-01-30"
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str, reserved: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r'\bat\b', '"at"', sql) if reserved else sql  # a reserved word there
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    return e.select(F.col("event_id").alias("attempt_id"), F.col("user_id").cast("string").alias("uid"), F.col("event_type").alias("exam"), F.concat(F.lit("S"), F.col("event_id") % 7).alias("subject"), F.concat(F.lit("T"), F.col("event_id") % 31).alias("topic"), (F.col("value") >= 10).alias("is_correct"), F.col("value").alias("seconds"), F.col("ts").alias("at"))


ATT = "a AS (SELECT event_id AS attempt_id, user_id::VARCHAR AS uid, event_type AS exam, 'S' || (event_id % 7) AS subject, 'T' || (event_id % 31) AS topic, value >= 10 AS is_correct, value AS seconds, ts AS at FROM events)"
OK = "sum(is_correct::INT)::BIGINT"
BOARD = f"g AS (SELECT uid, exam, count(*) AS n, {OK} AS r, max(at) AS at FROM a GROUP BY 1, 2), u AS (SELECT uid, sum(n)::BIGINT AS attempted, sum(r)::BIGINT AS correct, arg_max(exam, (n, exam)) AS top_exam, max(at) AS latest FROM g GROUP BY 1), s AS (SELECT *, correct * 10 + (attempted - correct) * 2 AS score, round_even(correct * 100.0 / attempted, 0)::DOUBLE AS accuracy FROM u WHERE trim(uid) <> '')"


@query(f"WITH {ATT}, {BOARD} SELECT *, row_number() OVER (ORDER BY score DESC, correct::DOUBLE / attempted DESC, attempted DESC, latest DESC, uid) AS rank FROM s")
def a16_w2_leaderboard(spark, sf):
    return L.leaderboard(attempts(spark, sf))


@query(f"WITH a0 AS (SELECT * FROM events WHERE ts >= date_trunc('week', TIMESTAMP '{AS_OF}')), {ATT.replace('FROM events', 'FROM a0')}, {BOARD} SELECT uid, score, row_number() OVER (ORDER BY score DESC, correct::DOUBLE / attempted DESC, attempted DESC, latest DESC, uid) AS rank FROM s")
def x43_weekly_leaderboard(spark, sf):
    return L.leaderboard(attempts(spark, sf), X.window_start("weekly", AS_OF)).select("uid", "score", "rank")


@query(f"WITH {ATT} SELECT uid, subject, {OK} AS correct, sum((NOT is_correct)::INT)::BIGINT AS incorrect, count(*) AS total, sum(CASE WHEN is_correct THEN 10 ELSE 2 END)::BIGINT AS xp FROM a GROUP BY 1, 2")
def a17_subject_stats(spark, sf):
    return L.by_subject(attempts(spark, sf))


@query(f"WITH {ATT} SELECT uid, at::DATE AS day, count(*) AS n FROM a GROUP BY 1, 2")
def a18_daily_activity(spark, sf):
    return L.daily_activity(attempts(spark, sf))


@query(f"WITH {ATT} SELECT uid, attempt_id, position FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY at DESC, attempt_id DESC) AS position FROM a) WHERE position <= 20")
def w6_recent_attempts(spark, sf):
    return L.recent(attempts(spark, sf)).select("uid", "attempt_id", "position")


WEAK = "{att}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY at DESC, attempt_id DESC) AS p FROM a), w AS (SELECT uid, {key}, count(*) AS total, sum(is_correct::INT)::BIGINT AS correct, round_even(sum(is_correct::INT) * 100.0 / count(*), 1)::DOUBLE AS accuracy FROM r WHERE p <= 500 GROUP BY 1, 2 HAVING count(*) >= {least})"


@query("WITH " + WEAK.format(att=ATT, key="subject", least=3) + " SELECT * FROM w")
def a19_weak_subjects(spark, sf):
    return L.weakness(attempts(spark, sf), "subject", 3)


@query("WITH " + WEAK.format(att=ATT, key="topic", least=2) + " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY accuracy, total DESC, topic) AS place FROM w) WHERE place <= 10")
def a19_weak_topics(spark, sf):
    return L.weakness(attempts(spark, sf), "topic", 2, top=10)


def gappy(spark, sf):
    """Attempts, some without subject, topic or pattern, on documents as questions."""
    e, n = attempts(spark, sf), F.col("attempt_id")
    return e.withColumns({
        "subject": F.when(n % 7 != 6, F.col("subject")), "topic": F.when(n % 31 == 30, "").otherwise(F.col("topic")), "subtopic": F.when(n % 3 != 0, F.concat(F.lit("U"), n % 3)),
        "question_id": n % 150, "pattern_tag": F.when(n % 3 == 0, F.concat(F.lit("P"), n % 5)).when(n % 3 == 1, ""),
    })


GAPPY = f"{ATT}, b AS (SELECT * REPLACE (CASE WHEN attempt_id % 7 = 6 THEN 'General' ELSE subject END AS subject, CASE WHEN attempt_id % 31 = 30 THEN 'General' ELSE topic END AS topic), CASE WHEN attempt_id % 3 = 0 THEN '' ELSE 'U' || (attempt_id % 3) END AS subtopic, attempt_id % 150 AS question_id, CASE WHEN attempt_id % 3 = 0 THEN 'P' || (attempt_id % 5) END AS tag, row_number() OVER (PARTITION BY uid ORDER BY at DESC, attempt_id DESC) AS p FROM a), r AS (SELECT * FROM b WHERE p <= 500)"
RATE = f"count(*) AS total, {OK} AS correct, round_even(sum(is_correct::INT) * 100.0 / count(*), 1)::DOUBLE AS accuracy"


@query(f"WITH {GAPPY} SELECT uid, subject, {RATE} FROM r GROUP BY 1, 2 HAVING count(*) >= 3")
def a19_subject_report(spark, sf):
    return L.weakness(gappy(spark, sf), "subject", 3)


@query(f"WITH {GAPPY}, w AS (SELECT uid, subject, topic, arg_min(subtopic, p) AS subtopic, min(p) AS newest, {RATE} FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 2) SELECT * EXCLUDE (newest) FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY accuracy, newest) AS place FROM w) WHERE place <= 10")
def a19_topic_report(spark, sf):
    return L.topic_report(gappy(spark, sf))


@query(f"WITH {GAPPY}, q AS (SELECT doc_id, 'P' || (doc_id % 6) AS t FROM documents WHERE doc_id % 4 <> 0), v AS (SELECT r.*, coalesce(tag, t) AS pattern_tag FROM r LEFT JOIN (SELECT DISTINCT * FROM q) q ON doc_id = question_id) SELECT uid, pattern_tag, {RATE} FROM v WHERE pattern_tag IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def a19_pattern_report(spark, sf):
    n = F.col("doc_id")
    questions = t(spark, sf, "documents").select(n.alias("id"), F.when(n % 4 != 0, F.concat(F.lit("P"), n % 6)).otherwise("").alias("pattern_tag"))
    return L.pattern_report(gappy(spark, sf), questions)


@query(f"WITH {ATT}, g AS (SELECT uid, subject, count(*) AS total, {OK} AS correct FROM a GROUP BY 1, 2 HAVING count(*) >= 5), h AS (SELECT *, floor(correct * 100.0 / total + 0.5)::BIGINT AS accuracy FROM g) SELECT *, accuracy - 70 AS gap, round_even(total * 100.0 / sum(total) OVER (PARTITION BY uid), 1)::DOUBLE AS share FROM h")
def a20_strength_gap(spark, sf):
    return L.strongest_gap(attempts(spark, sf))


@query(f"WITH {ATT} SELECT uid, CASE WHEN seconds <= 30 THEN 'Fast' WHEN seconds <= 60 THEN 'Balanced' ELSE 'Slow' END AS pace, count(*) AS n, {OK} AS correct FROM a GROUP BY 1, 2")
def a21_pace(spark, sf):
    return L.pace(attempts(spark, sf))


@query(f"WITH {ATT}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY at DESC, attempt_id DESC) AS p FROM a) SELECT uid, count(*) AS total, {OK} AS correct, count(*) - {OK} AS wrong, floor({OK} * 100.0 / count(*) + 0.5)::BIGINT AS accuracy, coalesce(floor(avg(seconds) FILTER (seconds > 0) + 0.5), 0)::BIGINT AS mean_s, coalesce(min(seconds) FILTER (seconds > 0), 0) AS least_s, coalesce(max(seconds) FILTER (seconds > 0), 0) AS most_s FROM r WHERE p <= 20 GROUP BY 1")
def a22_review_times(spark, sf):
    return L.review_times(attempts(spark, sf))


@query(f"WITH {ATT}, g AS (SELECT uid, topic, count(*) AS n FROM a WHERE NOT is_correct GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY n DESC, topic) AS place FROM g) WHERE place <= 5")
def a23_mistakes(spark, sf):
    return L.mistakes(attempts(spark, sf), "topic")


@query(f"WITH {ATT} SELECT attempt_id, uid, avg(is_correct::INT * 100.0) OVER (PARTITION BY uid ORDER BY at, attempt_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling FROM a")
def w3_rolling_accuracy(spark, sf):
    return L.rolling_accuracy(attempts(spark, sf)).select("attempt_id", "uid", "rolling")


@query(f"WITH {ATT}, d AS (SELECT DISTINCT uid, at::DATE AS day FROM a), i AS (SELECT uid, day - (row_number() OVER (PARTITION BY uid ORDER BY day))::INT AS g, day FROM d), r AS (SELECT uid, max(day) AS last, count(*) AS n FROM i GROUP BY uid, g) SELECT uid, coalesce(max(n) FILTER (last = DATE '{AS_OF}'), 0) AS streak, max(n) AS longest FROM r GROUP BY 1")
def w4_streak(spark, sf):
    return L.streak(attempts(spark, sf), AS_OF)


@query(f"WITH {ATT}, u AS (SELECT DISTINCT uid FROM a), d AS (SELECT uid, (DATE '{AS_OF}' - k::INT) AS day FROM u, range(7) AS x(k)) SELECT d.uid, d.day, count(attempt_id) AS n FROM d LEFT JOIN a ON a.uid = d.uid AND a.at::DATE = d.day GROUP BY 1, 2")
def w15_week_dots(spark, sf):
    return L.week_dots(attempts(spark, sf), AS_OF)


@query(f"WITH {ATT}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY at DESC, attempt_id DESC) AS p FROM a) SELECT uid, topic, min(p) AS last_seen FROM r GROUP BY 1, 2")
def w16_last_seen(spark, sf):
    return L.last_seen(attempts(spark, sf), "topic")


@query(f"WITH {ATT}, s AS (SELECT uid, subject, count(*) AS n, {OK} AS r FROM a GROUP BY 1, 2), u AS (SELECT uid, sum(n)::BIGINT AS n, sum(r)::BIGINT AS r, count(*) AS subjects, coalesce(max(floor(r::DOUBLE / n * 100 + 0.5)) FILTER (n >= 5), 0) AS best FROM s GROUP BY 1), d AS (SELECT DISTINCT uid, at::DATE AS day FROM a), i AS (SELECT uid, day, day - (row_number() OVER (PARTITION BY uid ORDER BY day))::INT AS g FROM d), k AS (SELECT uid, arg_max(n, last) AS streak FROM (SELECT uid, max(day) AS last, count(*) AS n FROM i GROUP BY uid, g) GROUP BY 1), x AS (SELECT *, r * 10 + (n - r) * 2 AS xp, floor(r::DOUBLE / n * 100 + 0.5) AS acc FROM u JOIN k USING (uid)), l AS (SELECT *, CASE WHEN xp >= 10000 THEN 6 WHEN xp >= 5000 THEN 5 WHEN xp >= 2500 THEN 4 WHEN xp >= 1200 THEN 3 WHEN xp >= 500 THEN 2 ELSE 1 END AS level FROM x) SELECT uid, xp, level, streak, n >= 10 AS first10, n >= 100 AS first100, n >= 500 AS first500, streak >= 7 AS streak7, streak >= 30 AS streak30, acc >= 70 AND n >= 20 AS acc70, acc >= 85 AND n >= 50 AS acc85, best >= 90 AS subject_pro, level >= 3 AS level3, level >= 5 AS level5, xp >= 5000 AS xp5000, subjects >= 5 AS all_subjects FROM l")
def a33_all_badges(spark, sf):
    return L.all_badges(attempts(spark, sf))


SM2 = """list_reduce(list_prepend({'i': 1, 'e': 2.5::DOUBLE, 'r': 0, 'q': 0}, list_transform(qs, lambda q: {'i': 0, 'e': 0.0::DOUBLE, 'r': 0, 'q': q})), lambda s, x: CASE WHEN x.q < 3
THEN {'i': 1, 'e': greatest(1.3, s.e - 0.2), 'r': 0, 'q': 0}
ELSE {'i': CASE s.r WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE round_even(s.i * greatest(1.3, s.e + (0.1 - (5 - x.q) * (0.08 + (5 - x.q) * 0.02))), 0)::INT END, 'e': round_even(greatest(1.3, s.e + (0.1 - (5 - x.q) * (0.08 + (5 - x.q) * 0.02))), 3)::DOUBLE, 'r': s.r + 1, 'q': 0} END)"""


@query(f"WITH {ATT}, c AS (SELECT uid, topic AS question_id, list(least(5, floor(seconds / 5))::INT ORDER BY at, attempt_id) AS qs, max(at) AS last FROM a GROUP BY 1, 2), f AS (SELECT *, {SM2} AS s FROM c) SELECT uid, question_id, s.i AS interval_days, s.e AS ease, s.r AS repetitions, (last::DATE + s.i)::DATE AS due_date FROM f")
def x41_sm2_schedule(spark, sf):
    return L.schedule(attempts(spark, sf).select("uid", F.col("topic").alias("question_id"), F.least(F.lit(5), F.floor(F.col("seconds") / 5)).cast("int").alias("quality"), "at"))


@query(f"WITH {ATT}, x AS (SELECT attempt_id, CASE WHEN attempt_id % 5 > 0 THEN uid ELSE '' END AS u, (attempt_id * 7) % 12000 AS xp, CASE WHEN attempt_id % 3 > 0 THEN 'Pro' END AS plan, CASE WHEN attempt_id % 4 > 0 THEN at END AS expires, seconds * 7 AS s FROM a) SELECT attempt_id, 'Aspirant ' || upper(left(CASE WHEN u = '' THEN 'user' ELSE u END, 4)) AS name, CASE WHEN xp >= 10000 THEN 6 WHEN xp >= 5000 THEN 5 WHEN xp >= 2500 THEN 4 WHEN xp >= 1200 THEN 3 WHEN xp >= 500 THEN 2 ELSE 1 END AS level, CASE WHEN expires < TIMESTAMP '2024-01-15' OR plan IS NULL THEN 'free' ELSE 'pro' END AS plan, CASE WHEN floor(s + 0.5) >= 60 THEN (floor(s + 0.5)::BIGINT // 60) || 'm ' || (floor(s + 0.5)::BIGINT % 60) || 's' ELSE floor(s + 0.5)::BIGINT || 's' END AS took, floor(s + 0.5)::INT AS took_s FROM x")
def x20_x42_x45_x47_learner_texts(spark, sf):
    n, a = F.col("attempt_id"), attempts(spark, sf)
    a = a.select("attempt_id", F.when(n % 5 > 0, F.col("uid")).otherwise("").alias("u"), ((n * 7) % 12000).alias("xp"), F.when(n % 3 > 0, "Pro").alias("plan"), F.when(n % 4 > 0, F.col("at")).alias("expires"), (F.col("seconds") * 7).alias("s"))
    took = X.duration_text("s")
    return a.select("attempt_id", X.masked_name("u").alias("name"), X.level("xp").alias("level"), X.effective_plan("plan", "expires", "2024-01-15").alias("plan"), took.alias("took"), X.duration_seconds(took).alias("took_s"))


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 > 0 THEN lower(source) || '|' || (2010 + doc_id % 9) || '|q' || (doc_id % 90) ELSE lower(source) || '|' || (2010 + doc_id % 9) || '|' || regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') || '|' || lang || '|A  B||' END) AS hash FROM documents WHERE lang = 'en'")
def d10_content_hash(spark, sf):
    n, d = F.col("doc_id"), t(spark, sf, "documents").where("lang = 'en'")
    d = d.select("doc_id", "text", F.col("lang").alias("a"), F.lit("A  B").alias("b"), F.lit("").alias("c"), F.lit(None).cast("string").alias("d"), F.concat(F.lit(" "), "source").alias("exam"), (n % 9 + 2010).alias("year"), F.when(n % 3 > 0, n % 90).alias("number"))
    return d.select("doc_id", X.content_hash("exam", "year", "number", "text", "a", "b", "c", "d").alias("hash"))


@query("SELECT l_orderkey, unnest(range(1, max(l_linenumber)::BIGINT + 1))::INT AS l_linenumber FROM lineitem GROUP BY 1 EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem")
def w13_missing_numbers(spark, sf):
    return I.missing_numbers(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, unnest(range(max(l_linenumber)::BIGINT + 1, 8))::INT AS l_linenumber FROM lineitem GROUP BY 1")
def n2_trailing_numbers(spark, sf):
    return I.trailing_numbers(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", 7)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def w12_duplicate_numbers(spark, sf):
    return I.duplicates(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("WITH g AS (SELECT l_orderkey, count(*) AS rows, count(l_linenumber) AS numbered, count(DISTINCT l_linenumber) AS d, max(l_linenumber) AS top FROM lineitem GROUP BY 1) SELECT l_orderkey, rows, numbered, CASE WHEN numbered >= greatest(5, floor(rows * 0.8)) THEN concat_ws(',', CASE WHEN d < numbered THEN 'duplicate-question-numbers' END, CASE WHEN d < top THEN 'missing-question-numbers' END, CASE WHEN numbered < rows THEN 'unnumbered-questions' END) ELSE '' END AS reasons FROM g")
def c6_numbering_reasons(spark, sf):
    return I.numbering_reasons(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_shipdate) AS n FROM lineitem) WHERE n = 1")
def d8_best_by_number(spark, sf):
    return I.winners(t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


PAPERS = "p AS (SELECT o_orderkey AS id, o_custkey AS exam, year(o_orderdate) AS year, CASE o_orderstatus WHEN 'F' THEN 'publishable' WHEN 'O' THEN 'publishable_with_hidden_rows' ELSE 'draft' END AS status, CASE o_orderkey % 11 WHEN 0 THEN 'archived' WHEN 1 THEN 'replaced' END AS lifecycle, (o_orderkey % 40)::BIGINT AS visible, (o_orderkey % 3)::BIGINT AS hidden, (o_orderkey % 50)::BIGINT AS total, (o_orderkey % 5)::INT AS version FROM orders)"


def papers(spark, sf):
    o = t(spark, sf, "orders")
    status, k = F.when(F.col("o_orderstatus") == "F", "publishable").when(F.col("o_orderstatus") == "O", "publishable_with_hidden_rows").otherwise("draft"), F.col("o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("exam"), F.year("o_orderdate").alias("year"), status.alias("status"), F.when(k % 11 == 0, "archived").when(k % 11 == 1, "replaced").alias("lifecycle"), (k % 40).alias("visible"), (k % 3).alias("hidden"), (k % 50).alias("total"), (k % 5).cast("int").alias("version"))


@query(f"WITH {PAPERS} SELECT exam, year, arg_max(id, (visible, total, CASE status WHEN 'publishable' THEN 4 ELSE 3 END, version, id)) AS id FROM p WHERE lifecycle IS DISTINCT FROM 'archived' AND status <> 'draft' AND total > 0 AND (visible > 0 OR hidden > 0) GROUP BY 1, 2")
def w7_latest_paper(spark, sf):
    return I.latest_paper(papers(spark, sf), ["exam", "year"]).select("exam", "year", "id")


@query(f"WITH {PAPERS} SELECT exam, year, max(version) + 1 AS next_version FROM p GROUP BY 1, 2")
def w9_next_version(spark, sf):
    return I.next_version(papers(spark, sf), ["exam", "year"])


@query(f"WITH {PAPERS} SELECT id, exam, year, version FROM (SELECT *, row_number() OVER (PARTITION BY exam, year, version ORDER BY total DESC, visible DESC, id DESC) AS n FROM p) WHERE n = 1")
def w1_ranked_papers(spark, sf):
    return I.winners(papers(spark, sf), ["exam", "year", "version"], [F.desc("total"), F.desc("visible"), F.desc("id")]).select("id", "exam", "year", "version")


@query(f"WITH {PAPERS}, k AS (SELECT id, first_value(id) OVER (PARTITION BY exam, year ORDER BY total DESC, id DESC) AS keep FROM p) SELECT l_orderkey AS child, l_linenumber AS number, coalesce(keep, l_orderkey) AS paper_id FROM lineitem LEFT JOIN k ON id = l_orderkey")
def j12_d16_repointed(spark, sf):
    children = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("child"), F.col("l_linenumber").alias("number"), F.col("l_orderkey").alias("paper_id"))
    return I.repoint(children, papers(spark, sf), ["exam", "year"], [F.desc("total"), F.desc("id")]).select("child", "number", "paper_id")


@query("WITH g AS (SELECT l_orderkey AS paper_id, count(*) AS total, sum((l_linestatus = 'O')::INT)::BIGINT AS shown, sum((l_linestatus <> 'O')::INT)::BIGINT AS hidden, sum((l_returnflag = 'R')::INT)::BIGINT AS structural FROM lineitem GROUP BY 1), h AS (SELECT *, greatest(3, ceil(total * 0.05))::BIGINT AS threshold FROM g) SELECT *, CASE WHEN total = 0 OR shown = 0 THEN 'blocked' WHEN structural >= threshold THEN 'reupload_needed' WHEN structural > 0 THEN 'publishable_with_hidden_rows' ELSE 'publishable' END AS status, CASE WHEN total > 0 THEN 'ingested' ELSE 'processing' END AS lifecycle FROM h")
def a13_publish_state(spark, sf):
    return I.publish_state(t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), (F.col("l_linestatus") == "O").alias("visible"), (F.col("l_returnflag") == "R").alias("structural")))


@query("SELECT r_name AS subject, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def a1_subject_counts(spark, sf):
    return geo(spark, sf).groupBy("subject").agg(F.count("*").alias("n"))


def geo(spark, sf):
    """Customers as questions: region is the subject, nation the topic, segment the subtopic."""
    c, n, r = t(spark, sf, "customer"), t(spark, sf, "nation"), t(spark, sf, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", F.col("r_name").alias("subject"), F.col("n_name").alias("topic"), F.col("c_mktsegment").alias("subtopic"), "c_acctbal")


GEO = "q AS (SELECT c_custkey, r_name AS subject, n_name AS topic, c_mktsegment AS subtopic, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {GEO} SELECT subject, topic, subtopic, count(*) AS n FROM q GROUP BY ROLLUP (subject, topic, subtopic)")
def a6_outline(spark, sf):
    return geo(spark, sf).rollup("subject", "topic", "subtopic").agg(F.count("*").alias("n"))


@query(f"WITH {GEO} SELECT subject, topic, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years, max(year(o_orderdate))::INT AS latest_year, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS latest_exam FROM q JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def a4_feed(spark, sf):
    q = geo(spark, sf).join(t(spark, sf, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return q.groupBy("subject", "topic").agg(F.count("*").alias("n"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.max(F.year("o_orderdate")).alias("latest_year"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("latest_exam"))


@query(f"WITH {GEO}, g AS (SELECT subject, topic, count(*) AS n FROM q GROUP BY 1, 2) SELECT *, floor(n * 100.0 / sum(n) OVER (PARTITION BY subject) + 0.5)::BIGINT AS weight FROM g")
def a7_w14_weightage(spark, sf):
    return geo(spark, sf).groupBy("subject", "topic").agg(F.count("*").alias("n")).withColumn("weight", X.percent_half_up("n", F.sum("n").over(Window.partitionBy("subject"))))


@query("SELECT count(*) AS total, sum((p_size <= 15)::INT)::BIGINT AS easy, sum((p_size BETWEEN 16 AND 35)::INT)::BIGINT AS medium, sum((p_size > 35)::INT)::BIGINT AS hard, count(DISTINCT p_brand) AS exams FROM part")
def a2_stats(spark, sf):
    n = lambda c: F.sum(c.cast("int"))
    return t(spark, sf, "part").agg(F.count("*").alias("total"), n(F.col("p_size") <= 15).alias("easy"), n(F.col("p_size").between(16, 35)).alias("medium"), n(F.col("p_size") > 35).alias("hard"), F.countDistinct("p_brand").alias("exams"))


@query("SELECT o_custkey AS exam, year(o_orderdate)::INT AS year, count(*) AS total, sum((o_orderstatus = 'F')::INT)::BIGINT AS present, round_even(sum((o_orderstatus = 'F')::INT) * 100.0 / count(*), 1)::DOUBLE AS coverage FROM orders GROUP BY 1, 2")
def a9_coverage(spark, sf):
    o = t(spark, sf, "orders").withColumn("exam", F.col("o_custkey")).withColumn("year", F.year("o_orderdate"))
    return I.coverage(o, ["exam", "year"], F.col("o_orderstatus") == "F")


@query("SELECT source, lang, count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest FROM documents GROUP BY 1, 2")
def a27_baseline_digest(spark, sf):
    return t(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.col("doc_id").cast("string")))), 256).alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j8_without_label(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j9_stale_semi_join(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@query("SELECT source, count(*) AS total, count(l.doc_id) AS explained, round_even(count(l.doc_id) * 100.0 / count(*), 1)::DOUBLE AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def a10_explained(spark, sf):
    d = t(spark, sf, "documents").join(t(spark, sf, "labels").select("doc_id", F.lit(1).alias("has")).distinct(), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("explained")).withColumn("coverage", X.percent("explained", "total"))


@query("WITH a AS (SELECT doc_id, lang AS v FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source ELSE lang END AS v FROM documents WHERE doc_id % 5 <> 0) SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b USING (doc_id)")
def j20_snapshot_diff(spark, sf):
    d = t(spark, sf, "documents")
    after = d.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.col("lang")).alias("v"))
    return I.changes(d.where("doc_id % 3 <> 0").select("doc_id", F.col("lang").alias("v")), after, ["doc_id"], "v")


@query("SELECT doc_id, 'old' AS src FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) AND quality = 1) UNION ALL SELECT DISTINCT doc_id, 'new' FROM labels WHERE quality = 1 ORDER BY 1")
def s11_upsert(spark, sf):
    new = t(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit("new").alias("src"))
    return I.upsert(t(spark, sf, "documents").select("doc_id", F.lit("old").alias("src")), new, ["doc_id"], ["src"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def t2_page(spark, sf):
    return I.page(t(spark, sf, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 50, 25).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#1')")
def f7_search(spark, sf):
    return t(spark, sf, "part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("brand#1")).select("p_partkey")


@query("SELECT lower(left(text, 80)) AS head, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def d12_same_beginning(spark, sf):
    return I.duplicates(t(spark, sf, "documents").select(F.lower(F.substring("text", 1, 80)).alias("head")), ["head"])


@query("SELECT doc_id, sha256(text || '|' || source) AS hash, md5(text) AS cache_key FROM documents")
def x48_hashes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(F.concat_ws("|", "text", "source"), 256).alias("hash"), F.md5(F.col("text").cast("binary")).alias("cache_key"))


@query(r"WITH n AS (SELECT doc_id, length(regexp_replace(text, '[\p{C}\p{Z}]', '', 'g')) AS n, length(regexp_replace(text, '[^\x{80}-\x{FF}]|[\p{C}\p{Z}]', '', 'g')) AS e, length(regexp_replace(text, '[^\x21-\x7E]', '', 'g')) AS a FROM documents) SELECT doc_id, n >= 8 AND e > 0.08 * n AS garbled, n > 0 AND a > 0.3 * n AND NOT (n >= 8 AND e > 0.08 * n) AS english FROM n")
def x10_x11_garbled_english(spark, sf):
    return t(spark, sf, "documents").select("doc_id", X.garbled("text").alias("garbled"), X.english("text").alias("english"))


@query("WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), b AS (SELECT conv_id, turn, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS p, length(text) AS n FROM conversations) SELECT conv_id, coalesce(sum((p >= n)::INT), 0)::BIGINT AS breaks FROM b GROUP BY 1")
def w10_breaks(spark, sf):
    return I.break_count(t(spark, sf, "conversations").withColumn("n", F.length("text")), "conv_id", "n", "turn")


@query("WITH g AS (SELECT conv_id, role, min(turn) AS start FROM conversations GROUP BY 1, 2), e AS (SELECT conv_id, max(turn) AS stop FROM conversations GROUP BY 1) SELECT conv_id, role, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY start, role) - 1, stop) AS stop FROM g JOIN e USING (conv_id)")
def s10_shift_spans(spark, sf):
    return I.spans(t(spark, sf, "conversations"), "conv_id", ["role"], "turn")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations")
def w11_carried_forward(spark, sf):
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return I.carried_forward(c, "conv_id", "asked", "turn")


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/#?]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages")
def s7_page_fields(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/#?]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u1_union(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT s_nationkey AS nation, s_name, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n <= 8")
def t10_top_per_group(spark, sf):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return t(spark, sf, "supplier").withColumn("n", F.row_number().over(w)).where("n <= 8").select(F.col("s_nationkey").alias("nation"), "s_name", "s_acctbal")


@query("WITH w AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id, n, n > 2 AS rejected FROM w")
def r1_rate_window(spark, sf):
    w = Window.partitionBy("user_id").orderBy("_s").rangeBetween(-3600, 0)
    e = t(spark, sf, "events").withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    return e.withColumn("n", F.count("*").over(w)).select("event_id", "n", (F.col("n") > 2).alias("rejected"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey % 5 = 0 OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 5 = 0)")
def j22_prefer_hits(spark, sf):
    return I.prefer_hits(t(spark, sf, "lineitem"), ["l_orderkey"], F.col("l_suppkey") % 5 == 0).select("l_orderkey", "l_linenumber", "l_suppkey")
