"""Queries of joins, keys, histories, model answers, trigrams and stateful streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answer_keys as A
from ..operators import desk as D
from ..operators import hooks as H
from ..operators import identity as I
from ..operators import learner as L
from ..operators import patterns as P
from ..operators import quality as Q
from ..operators import similar as S
from ..sources import versions
from ..streaming import stateful as ST
from .banks import BANK, bank
from .keys import _LETTER, laid_out
from .keys import written as keys_written
from .patterns import _ASKED, _MARKED_SQL, asked
from .queries import query, t

# joins and lookups


@query("WITH q AS (SELECT p_partkey AS id, max(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END) AS tag FROM part GROUP BY 1) SELECT event_id, coalesce(nullif(CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN '' END, ''), nullif(tag, '')) AS pattern_tag FROM events LEFT JOIN q ON id = event_id % 2500")
def j2_pattern_tags(spark, sf):
    n = F.col("event_id")
    attempts = t(spark, sf, "events").select("event_id", (n % 2500).alias("question_id"), F.when(n % 4 == 0, F.col("event_type")).when(n % 4 == 1, "").alias("pattern_tag"))
    questions = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("pattern_tag"))
    return L.with_pattern_tags(attempts, questions).select("event_id", "pattern_tag")


@query("WITH r AS (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200) SELECT o_orderkey AS id, c_mktsegment AS exam_name, (c_nationkey + 2000)::INT AS exam_year, c_nationkey AS question_number FROM r JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'")
def j6_listed_repairs(spark, sf):
    repairs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("question_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    questions = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("exam_name"), (F.col("c_nationkey") + 2000).cast("int").alias("exam_year"), F.col("c_nationkey").alias("question_number"))
    return D.listed_repairs(repairs, questions, "BUILDING", None, "O").select("id", "exam_name", "exam_year", "question_number")


@query("""WITH q AS (SELECT event_id AS id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN user_id % 2 = 0 THEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) // 9 ELSE 0 END)::INT AS num, event_id % 7 < 2 AS img, event_id % 7 = 0 AS parent, event_id % 3 > 0 AS refers FROM events),
p AS (SELECT a.id, max(b.num) AS m FROM q a JOIN q b ON a.user_id = b.user_id AND b.num < a.num AND b.num >= a.num - 10 AND b.img GROUP BY 1),
g AS (SELECT a.id, b.id AS of, a.num - b.num AS d, b.parent, (SELECT count(*) FROM q c WHERE c.user_id = a.user_id AND c.num BETWEEN b.num AND a.num) = a.num - b.num + 1 AS whole FROM q a JOIN p USING (id) JOIN q b ON a.user_id = b.user_id AND b.num = m)
SELECT q.id, img OR coalesce(parent_of, false) AS has_image, CASE WHEN img THEN 'i' || q.id WHEN parent_of THEN 'i' || of ELSE '' END AS image_url FROM q LEFT JOIN (SELECT g.id, of, g.parent AND whole AND refers AS parent_of FROM g JOIN q ON q.id = g.id) h ON h.id = q.id""")
def j19_data_images(spark, sf):
    from pyspark.sql import Window

    n, w = F.col("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("id"))
    e = t(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    number = (w + F.when(F.col("user_id") % 2 == 0, F.expr("row_number() OVER (PARTITION BY user_id ORDER BY id) DIV 9")).otherwise(0)).cast("int")
    text = F.when(n % 7 == 0, F.concat(F.lit("[Pie chart] of "), "event_type")).when(n % 3 > 0, F.concat(F.lit("Based on the "), "event_type", F.lit(" data, how many?"))).otherwise("How many?")
    rows = e.select("id", "user_id", number.alias("question_number"), text.alias("question_text"), (n % 7 < 2).alias("has_image"), F.when(n % 7 < 2, F.concat(F.lit("i"), n)).otherwise("").alias("image_url"))
    return I.data_images(rows, ["user_id"]).select("id", "has_image", "image_url")


@query("SELECT p_partkey AS id, upper(p_brand) || '|' || upper(split_part(p_type, ' ', 1)) || CASE WHEN contains(p_type, ' ') THEN '|' || upper(p_type) ELSE '' END AS scope FROM part")
def x19_scopes(spark, sf):
    raw = F.concat("p_brand", F.lit(", "), F.lower("p_brand"), F.lit(" ,,"), F.substring_index("p_type", " ", 1), F.lit(","), "p_type")
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(X.scope(raw), "|").alias("scope"))


# keys


@query(f"WITH a AS (SELECT l_orderkey AS k, l_linenumber::INT AS n, min({_LETTER}) AS x FROM lineitem GROUP BY 1, 2), e AS (SELECT k, count(*) FILTER (n <= CASE WHEN k % 3 = 0 THEN top ELSE 4 END) AS c, any_value(top) AS top FROM (SELECT *, max(n) OVER (PARTITION BY k) AS top FROM a) GROUP BY 1) SELECT k AS key_id, c / CASE WHEN k % 3 = 0 THEN top ELSE 4 END AS score FROM e")
def a36_coverage(spark, sf):
    """The share of the expected numbers that a key covers; without an expected count up to its largest number."""
    keys = keys_written(spark, sf).withColumn("answers", A.by_strategy(laid_out("N", ". ", "L"), "inline"))
    return keys.select("key_id", A.coverage("answers", F.when(F.col("key_id") % 3 > 0, 4)).alias("score"))


@query(f"WITH a AS (SELECT l_orderkey AS key_id, l_linenumber::INT AS number, min({_LETTER}) AS answer FROM lineitem GROUP BY 1, 2) SELECT key_id, number, answer FROM a UNION ALL SELECT DISTINCT l_orderkey, 7 + l_linenumber::INT, CASE WHEN l_linenumber % 2 = 0 THEN 'DELETED' ELSE 'A|C' END FROM lineitem")
def u6_merged_answers(spark, sf):
    """The strategy's answers beat the special states of the same numbers; these fill in the others."""
    own = A.by_strategy(laid_out("N", ". ", "L"), "inline")
    states = F.array_join(F.transform("pairs", lambda p: F.concat(p["number"].cast("string"), F.lit(" X\n"), (p["number"] + 7).cast("string"), F.when(p["number"] % 2 == 0, " X").otherwise(" A or C"))), "\n")
    keys = keys_written(spark, sf).withColumn("answers", A.merged(own, A.special(states)))
    return keys.select("key_id", F.inline("answers"))


# learner


@query("WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island FROM d) SELECT user_id::VARCHAR AS uid, day, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM i", reserved=False)
def w5_streak_by_day(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("ts").alias("at"))
    return L.streak_by_day(e)


@query("SELECT source, lang, arg_max(text, (length(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), text)) AS text FROM documents GROUP BY 1, 2")
def d5_richer_text(spark, sf):
    return t(spark, sf, "documents").groupBy("source", "lang").agg(I.richer("text").alias("text"))


# rows


@query(f"WITH {BANK}, p AS (SELECT id, CASE id % 4 WHEN 0 THEN question_text || chr(10) || chr(10) || '__MATCH__:' || '{{\"col1\": [\"a\"' WHEN 1 THEN question_text || chr(10) || chr(10) || '__MATCH__:' || '{{\"col1\": [\"a\"], \"col2\": []}}' WHEN 2 THEN 'Match the following ' || question_text ELSE question_text END AS q FROM q) SELECT id, CASE id % 4 WHEN 0 THEN 'invalid-match-payload' WHEN 1 THEN 'incomplete-match-columns' ELSE '' END AS codes FROM p WHERE id % 4 < 2")
def x32_match_payloads(spark, sf):
    """A payload that is no JSON and one with an empty column are issues of the row, and no errors."""
    n, end = F.col("id"), F.lit('\n\n__MATCH__:{"col1": ["a"')
    text = F.when(n % 4 == 0, F.concat("question_text", end)).otherwise(F.concat("question_text", end, F.lit('], "col2": []}')))
    rows = bank(spark, sf).where("id % 4 < 2").withColumns({"question_text": text, "question_type": F.lit("match"), "has_image": F.lit(False)})
    codes = F.filter(Q.issue_codes(), lambda c: c.contains("match"))
    return rows.select("id", F.array_join(codes, ",").alias("codes"))


_LEFT = "array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '[\\x{{0900}}-\\x{{097F}}]', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), chr(10)), lambda s: regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda s: s <> ''), chr(10))"


@query(f"WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, 'e', 'क') WHEN 2 THEN 'कखग ' || left(text, 6) ELSE left(text, 1) || 'कख' END AS x FROM documents), s AS (SELECT doc_id, x, {_LEFT.format(x='x')} AS y, length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(x, '[^कखग]', '', 'g')) AS other FROM d) SELECT doc_id AS id, y AS question_text FROM s WHERE length(y) >= 5 AND NOT (letters > 0 AND other / letters >= 0.35 AND length(regexp_replace(y, '[^A-Za-z]', '', 'g')) < 20)")
def c11_cleaned(spark, sf):
    n, d = F.col("doc_id"), t(spark, sf, "documents")
    text = F.when(n % 4 == 0, F.col("text")).when(n % 4 == 1, F.replace("text", F.lit("e"), F.lit("क"))).when(n % 4 == 2, F.concat(F.lit("कखग "), F.substring("text", 1, 6))).otherwise(F.concat(F.substring("text", 1, 1), F.lit("कख")))
    rows = d.select(n.alias("id"), text.alias("question_text"), *(F.lit("").alias(o) for o in Q.OPTIONS))
    return Q.cleaned(rows).select("id", "question_text")


_FOLD = "SELECT question_id AS q, key, arg_max(value, (at, id)) AS value, arg_max(id, (at, id)) AS src FROM e GROUP BY 1, 2"


@query(f"""WITH {BANK}, r AS (SELECT event_id AS id, event_id % 1500 AS question_id, ts AS at, event_id % 4 AS k FROM events WHERE event_id % 5 > 0),
e AS (SELECT id, question_id, at, 'correct_answer' AS key, substr('ABCD', (id % 4)::INT + 1, 1) AS value FROM r WHERE k < 2 UNION ALL SELECT id, question_id, at, 'needs_review', CASE WHEN k = 0 THEN 'true' ELSE 'false' END FROM r WHERE k < 2 UNION ALL SELECT id, question_id, at, 'option_a', 'new ' || id FROM r WHERE k = 2),
n AS ({_FOLD}), a AS (SELECT q, list_sort(list_distinct(list(src))) AS applied FROM n GROUP BY 1), l AS (SELECT question_id AS q, list_sort(list_distinct(list(id))) AS every FROM e GROUP BY 1)
SELECT q.id, coalesce(x.value, correct_answer) AS correct_answer, coalesce(y.value::BOOLEAN, needs_review) AS needs_review, coalesce(z.value, option_a) AS option_a, coalesce(array_to_string(applied, ','), '') AS applied, coalesce(array_to_string(list_filter(every, lambda i: NOT list_contains(applied, i)), ','), '') AS overruled
FROM q LEFT JOIN n x ON x.q = q.id AND x.key = 'correct_answer' LEFT JOIN n y ON y.q = q.id AND y.key = 'needs_review' LEFT JOIN n z ON z.q = q.id AND z.key = 'option_a' LEFT JOIN a ON a.q = q.id LEFT JOIN l ON l.q = q.id""")
def c25_c3_repair_history(spark, sf):
    e, n, k = t(spark, sf, "events"), F.col("event_id"), F.col("event_id") % 4
    patch = F.when(k < 2, F.create_map(F.lit("correct_answer"), F.substring(F.lit("ABCD"), (n % 4).cast("int") + 1, F.lit(1)), F.lit("needs_review"), F.when(k == 0, "true").otherwise("false"))).when(k == 2, F.create_map(F.lit("option_a"), F.concat(F.lit("new "), n)))
    proposals = e.select(n.alias("id"), (n % 1500).alias("question_id"), F.col("ts").alias("created_at"), F.when(n % 5 > 0, "proposed").otherwise("applied").alias("status"), F.when(k == 2, "options_cleanup").otherwise("answer_correction").alias("repair_type"), patch.alias("proposed_patch"))
    out = Q.with_history(bank(spark, sf), proposals)
    return out.select("id", "correct_answer", "needs_review", "option_a", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("applied", "overruled")))


@query(f"WITH {BANK}, {_ASKED}, {_MARKED_SQL} SELECT trap AS trap_tag, style AS question_style, count(*) AS questions, count(tag) AS tagged FROM m GROUP BY 1, 2")
def c18_c19_traps_and_styles(spark, sf):
    out = P.classified(asked(spark, sf))
    return out.groupBy("trap_tag", "question_style").agg(F.count("*").alias("questions"), F.count("pattern_tag").alias("tagged"))


_TEXT = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[a-z]', 'త', 'g') WHEN 2 THEN regexp_replace(text, '[a-z]', 'ж', 'g') WHEN 3 THEN '' ELSE regexp_replace(text, '[A-Za-z .]', 'é', 'g') END"
_N = "length(regexp_replace({x}, '[\\s\\p{{Z}}\\p{{C}}]', '', 'g'))"


@query(rf"WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UPSC ' || source ELSE source END AS exam, {_TEXT} AS x FROM documents), n AS (SELECT *, {_N.format(x='x')} AS n, length(regexp_replace(x, '[^\x{{0080}}-ÿ]|[\p{{Z}}\p{{C}}]', '', 'g')) AS high, length(regexp_replace(x, '[^!-~]', '', 'g')) AS low, length(regexp_replace(x, '[^త]', '', 'g')) AS telugu, length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) AS letters FROM d), g AS (SELECT *, n >= 8 AND high > 0.08 * n AS garbled FROM n) SELECT doc_id, x <> '' AND NOT garbled AND (exam LIKE 'UPSC %' OR n > 0 AND (low > 0.3 * n OR 2 * telugu <= letters)) AS kept FROM g")
def f20_english_questions(spark, sf):
    n, d = F.col("doc_id"), t(spark, sf, "documents")
    text = F.when(n % 5 == 0, F.col("text")).when(n % 5 == 1, F.regexp_replace("text", "[a-z]", "త")).when(n % 5 == 2, F.regexp_replace("text", "[a-z]", "ж")).when(n % 5 == 3, "").otherwise(F.regexp_replace("text", "[A-Za-z .]", "é"))
    exam = F.when(n % 3 == 0, F.concat(F.lit("UPSC "), "source")).otherwise(F.col("source"))
    return d.select("doc_id", X.kept_as_english(text, exam).alias("kept"))


# model answers


def length_hook(texts: list[str]) -> list[str | None]:
    """Stands for a model: it has no answer for texts of a length divisible by 7, and fails on batches with one divisible by 11."""
    if len(texts) > 1 and any(len(x) % 11 == 0 for x in texts):
        raise RuntimeError("the model is busy")
    return [None if len(x) % 7 == 0 or len(x) % 11 == 0 else f"{len(x)}:{x[:1]}" for x in texts]


@query("SELECT doc_id, CASE WHEN md5('v1' || chr(10) || text)[1] < '4' THEN 'known' WHEN length(text) % 7 = 0 OR length(text) % 11 = 0 THEN lang ELSE length(text) || ':' || left(text, 1) END AS answer, CASE WHEN md5('v1' || chr(10) || text)[1] < '4' THEN 'cache' WHEN length(text) % 7 = 0 OR length(text) % 11 = 0 THEN 'rules' ELSE 'model' END AS answer_source FROM documents")
def v4_x48_model_answers(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text", "lang")
    cache = d.select(H.cache_key("text", "v1").alias("key"), F.lit("known").alias("answer")).where("key < '4'")
    return H.answered(d, "text", length_hook, "v1", cache, F.col("lang"), batch=4, tries=3)[0].select("doc_id", "answer", "answer_source")


# trigrams

_GRAMS = "list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower({x}), '[\\pL\\pN]+')), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"WITH n AS (SELECT DISTINCT left(text, 40) AS x FROM documents), g AS (SELECT x, {_GRAMS.format(x='x')} AS g FROM n), p AS (SELECT a.x AS text_a, b.x AS text_b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS s FROM g a JOIN g b ON a.x < b.x) SELECT text_a, text_b, n / (s - n) AS similarity FROM p WHERE n >= 0.5 * (s - n) AND n > 0")
def d13_similar_openings(spark, sf):
    """Pairs of different openings of whole documents that share half of their trigrams."""
    return S.similar_pairs(t(spark, sf, "documents").select(F.substring("text", 1, 40).alias("x")), "x", 0.5)


@query(f"WITH q AS (SELECT DISTINCT p_name AS x FROM part WHERE p_partkey % 50 = 0), r AS (SELECT DISTINCT p_name AS x FROM part), a AS (SELECT x, {_GRAMS.format(x='x')} AS g FROM q), b AS (SELECT x, {_GRAMS.format(x='x')} AS g FROM r), p AS (SELECT a.x AS text_a, b.x AS text_b, len(list_intersect(a.g, b.g)) AS n, len(a.g) + len(b.g) AS s FROM a, b) SELECT text_a, text_b, n / (s - n) AS similarity FROM p WHERE n >= 0.6 * (s - n)")
def d13_similar_names(spark, sf):
    """For the names of every fiftieth part the names of parts that are like them."""
    p = t(spark, sf, "part")
    return S.search(p.where("p_partkey % 50 = 0"), "p_name", p, "p_name", 0.6)


# streams


def _streamed(spark, sf, build, write, half="2024-01-15"):
    """`events` in two parts, each run through build until all is read, by one checkpoint: the second run finds the state of the
    first.  write(writer, folder) says where rows go; returns that folder."""
    folder, key = f"{versions.shared_folder(spark)}/stream-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    events, before = t(spark, sf, "events"), spark.conf.get(key, None)
    spark.conf.set(key, ST.STORE)
    try:
        for part in (F.col("ts") < half, ~(F.col("ts") < half)):
            events.where(part).write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
            write(build(stream).writeStream, f"{folder}/out").option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return f"{folder}/out"


def _appended(writer, folder):
    return writer.format("parquet").option("path", folder).outputMode("append")


def _by_batch(writer, folder):
    """Each micro-batch in a folder of its own, written anew if the batch is run again."""
    return writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")).outputMode("update")


@query("SELECT user_id::VARCHAR AS uid, event_id AS request_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 21600000001 PRECEDING) AS requests, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 21600000001 PRECEDING) > 2 AS rejected FROM events")
def r1_rate_limit_stream(spark, sf):
    """More than two requests of a user within six hours, as a stream."""
    build = lambda e: ST.rate_limited(e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at")), 21_600, 2)
    return spark.read.schema(ST.DECISIONS).parquet(_streamed(spark, sf, build, _appended))


@query("WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS island, max(day) OVER (PARTITION BY user_id) AS last FROM d), s AS (SELECT user_id, count(*) AS streak, max(day) AS day, any_value(last) AS last FROM i GROUP BY user_id, island), r AS (SELECT user_id, array_to_string(list(event_id ORDER BY ts DESC, event_id DESC)[1:20], ',') AS recent, count(*) AS attempted, count(*) FILTER (value >= 10) AS correct FROM events GROUP BY 1) SELECT user_id::VARCHAR AS uid, attempted, correct, 10 * correct + 2 * (attempted - correct) AS xp, streak, last AS last_day, recent FROM r JOIN s USING (user_id) WHERE day = last", reserved=False)
def r4_running_stats_stream(spark, sf):
    build = lambda e: ST.running_stats(e.select(F.col("user_id").alias("uid"), F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") >= 10).alias("is_correct")))
    rows = spark.read.schema(ST.STATS).parquet(_streamed(spark, sf, build, _by_batch))
    newest = rows.groupBy("uid").agg(F.max_by(F.struct("attempted", "correct", "xp", "streak", "last_day", "recent"), "attempted").alias("s")).select("uid", "s.*")
    return newest.withColumn("recent", F.array_join("recent", ","))


@query("SELECT event_id, event_type, CASE WHEN value >= 10 THEN 'right' ELSE 'wrong' END AS tag FROM events")
def r7_resumed_tagging(spark, sf):
    """Tagging as a stream that stops and starts again: the second run takes only what is new."""
    tags = lambda e: e.select("event_id", "event_type", F.when(F.col("value") >= 10, "right").otherwise("wrong").alias("tag"))
    return spark.read.schema("event_id long, event_type string, tag string").parquet(_streamed(spark, sf, tags, _appended))
