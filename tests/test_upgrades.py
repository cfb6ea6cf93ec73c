"""Trigram joins, model answers, repair histories, data images, versions of papers and stateful streams against plain versions."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quizlake.functions import text as X
from quizlake.operators import desk, hooks, identity, learner, similar, upkeep
from quizlake.operators import quality as Q
from quizlake.streaming import stateful


def grams(x):
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", (x or "").lower()) for i in range(len(w) + 1)}


def likeness(a, b):
    return len(grams(a) & grams(b)) / max(1, len(grams(a) | grams(b)))


@pytest.mark.parametrize("share", [0.25, 0.5, 0.75, 1.0])
def test_similar_pairs(spark, share):
    rng = random.Random(4)
    words = ["river", "rivers", "delta", "deltas", "lake", "lakes", "é", "42", "a-b"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(120)] + ["River", "river", "river", "", None, " .,", "x"]
    df = spark.createDataFrame([(x, 1) for x in texts], "x string, text int")
    got = similar.similar_pairs(df, "x", share).collect()
    different = sorted({x for x in texts if grams(x)})
    want = {(a, b): likeness(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if likeness(a, b) >= share - 1e-12}
    assert {(r.text_a, r.text_b): pytest.approx(r.similarity) for r in got} == want and len(got) == len(want)
    asked = ["river deltas", "nothing like it", "LAKE lake", None]
    found = similar.search(spark.createDataFrame([(x,) for x in asked], "q string"), "q", df, "x", share).collect()
    assert {(r.text_a, r.text_b) for r in found} == {(q, x) for q in asked for x in different if grams(q) and likeness(q, x) >= share - 1e-12} and len(found) == len({(r.text_a, r.text_b) for r in found})


def test_similar_bounds(spark):
    df = spark.createDataFrame([], "x string")
    assert similar.similar_pairs(df, "x", 0.5).count() == 0
    for share in (0, -1, 1.1, float("nan")):
        with pytest.raises(ValueError):
            similar.similar_pairs(df, "x", share)


def test_model_answers(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def hook(texts):
        with open(calls, "a") as f:
            f.write("".join(f"{x}|{len(texts)}\n" for x in texts))
        if len(texts) > 1 and "busy" in texts:
            raise RuntimeError("busy")
        return [None if x in ("none", "busy too") else x.upper() for x in texts]

    rows = spark.createDataFrame([(i, x, "rule" if i % 2 else None) for i, x in enumerate(["a", "a", "b", "busy", None, "none", "none", "known", "d"])], "id int, text string, rule string").coalesce(1)
    cache = spark.createDataFrame([(None, "x"), ("k", None)], "key string, answer string").unionByName(rows.where("text = 'known'").select(hooks.cache_key("text", "1").alias("key"), F.lit("cached").alias("answer")))
    out, kept = hooks.answered(rows, "text", hook, "1", cache, F.col("rule"), batch=8)
    got = {r.id: (r.answer, r.answer_source) for r in out.collect()}
    assert got == {0: ("A", "model"), 1: ("A", "model"), 2: ("B", "model"), 3: ("BUSY", "model"), 4: ("", "model"), 5: ("rule", "rules"), 6: (None, None), 7: ("cached", "cache"), 8: ("D", "model")}
    assert {r.id: r.answer_problem for r in out.collect()}[6] == "no answer"
    seen = [x.split("|")[0] for x in open(calls).read().splitlines()]
    assert "known" not in seen and seen.count("none") == 3
    again, _ = hooks.answered(rows, "text", hook, "1", kept, F.col("rule"), batch=8)
    assert {r.answer_source for r in again.where("id IN (0, 2, 3, 8)").collect()} == {"cache"}
    other, _ = hooks.answered(rows.limit(1), "text", lambda texts: [], "2", kept, tries=1)
    assert other.first().answer is None and "0 answers to 1 texts" in other.first().answer_problem


def test_repair_history(spark):
    kind = "id int, question_text string, option_a string, option_b string, option_c string, option_d string, question_number int, exam_name string, question_type string, subject string, topic string, subtopic string, correct_answer string, answer_status string, needs_review boolean, has_image boolean, image_url string, explanation_status string, is_active boolean"
    row = lambda i: (i, "Which of these is the right one?", "w", "x", "y", "z", 1, "E", None, "Sub", "Top", "In", "A", None, False, False, None, None, True)
    rows = spark.createDataFrame([row(1), row(2), row(3)], kind)
    at = lambda n: None if n is None else dt.datetime(2024, 1, n)
    made = [(1, 1, at(1), "proposed", "answer_correction", {"correct_answer": "B", "needs_review": "true"}), (2, 1, at(2), "proposed", "options_cleanup", {"option_a": "new"}), (3, 1, at(3), "proposed", "answer_correction", {"correct_answer": "C"}), (4, 1, at(9), "applied", "answer_correction", {"correct_answer": "D"}), (5, 1, at(4), "proposed", "other", {"correct_answer": "D"}), (6, 2, None, "proposed", "answer_correction", {"correct_answer": "B"}), (7, 2, at(1), "proposed", "answer_correction", {"correct_answer": "D"}), (8, None, at(1), "proposed", "answer_correction", {"correct_answer": "D"}), (9, 3, at(1), "proposed", "answer_correction", None)]
    proposals = spark.createDataFrame(made, "id int, question_id int, created_at timestamp, status string, repair_type string, proposed_patch map<string,string>")
    got = {r.id: r for r in Q.with_history(rows, proposals).collect()}
    assert (got[1].correct_answer, got[1].option_a, got[1].needs_review, got[1].applied, got[1].overruled) == ("C", "new", True, [1, 2, 3], [])
    assert (got[2].correct_answer, got[2].applied, got[2].overruled) == ("D", [7], [6]) and (got[3].correct_answer, got[3].applied) == ("A", [])
    assert got[1].review_required and got[1].answer_status != "verified" and got[3].answer_status == "verified"
    assert Q.with_history(rows.limit(0), proposals).count() == 0 and Q.with_history(rows, proposals.limit(0)).count() == 3


def test_data_images(spark):
    ask, image = "Based on the above data, how many?", "[TABLE] of x"
    rows = [(1, image, True, "i1"), (2, ask, False, None), (3, "no reference", None, None), (4, ask, False, ""), (6, ask, False, None), (10, "a picture", True, "i2"), (11, ask, False, None), (20, image, True, ""), (21, ask, False, None), (30, image, True, "i3"), *((n, ask, False, None) for n in range(31, 43)), (None, ask, False, None), (0, ask, None, None)]
    out = identity.data_images(spark.createDataFrame([("k", *r) for r in rows], "k string, question_number int, question_text string, has_image boolean, image_url string"), ["k"]).collect()
    assert len(out) == len(rows) and {r.question_number: r.image_url for r in out if r.has_image} == {1: "i1", 2: "i1", 4: "i1", 10: "i2", 20: "", 30: "i3", **{n: "i3" for n in range(31, 41)}}


def test_small_ones(spark):
    df = spark.createDataFrame([(" a, B ,,a,c",), (None,), ("",)], "x string")
    assert [r[0] for r in df.select(X.scope("x")).collect()] == [["A", "B", "C"], [], []]
    papers = spark.createDataFrame([(1, "E", 2020, 3, "ingested"), (2, "E", 2020, 1, "ingested")], "id int, exam_name string, exam_year int, upload_version int, lifecycle_status string")
    uploads = spark.createDataFrame([(11, "E", 2020), (10, "E", 2020), (12, "F", 2020)], "id int, exam_name string, exam_year int")
    got = {r.id: (r.upload_version, r.lifecycle_status, r.supersedes) for r in upkeep.new_versions(papers, uploads).collect()}
    assert got == {1: (3, "replaced", None), 2: (1, "ingested", None), 10: (4, "replaced", 1), 11: (5, "processing", 10), 12: (1, "processing", None)}
    repairs = spark.createDataFrame([(i, i % 3, "proposed" if i else "applied", dt.datetime(2024, 1, 1 + i)) for i in range(6)], "id int, question_id int, status string, created_at timestamp")
    questions = spark.createDataFrame([(0, "E", 2020, 1), (1, "E", 2021, 2), (2, "F", 2020, 3)], "id int, exam_name string, exam_year int, question_number int")
    ids = lambda *a, **k: sorted(r.id for r in desk.listed_repairs(repairs, questions, *a, **k).collect())
    assert (ids(), ids("E"), ids("E", 2021), ids(exam_year=2020), ids("E", limit=2), ids(status=None)) == ([1, 2, 3, 4, 5], [1, 3, 4], [1, 4], [2, 3, 5], [4], [0, 1, 2, 3, 4, 5])
    days = spark.createDataFrame([("a", dt.datetime(2024, 1, d)) for d in (1, 1, 2, 3, 5)] + [(None, dt.datetime(2024, 1, 1))], "uid string, at timestamp")
    assert sorted((r.uid or "", r.day.day, r.streak) for r in learner.streak_by_day(days).collect()) == [("", 1, 1), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("a", 5, 1)]


T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, rows, kind, tmp_path, build, mode):
    """The rows, in batches of a file each, through build; state and output in tmp_path."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    got = []
    try:
        for k in range(3):
            spark.createDataFrame(rows[k::3] if mode == "any" else rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
            build(stream).writeStream.foreachBatch(lambda df, n: got.extend((n, r) for r in df.collect())).outputMode("update" if mode == "update" else "append").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return got


def test_rate_limit_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "b", None]), i, T0 + dt.timedelta(seconds=7 * i + rng.choice([0, 0, 3]))) for i in range(300)]
    rows[150:] = [(u, i, at + dt.timedelta(hours=2)) for u, i, at in rows[150:]]  # idle in between: timers end the state
    got = {r.request_id: (r.requests, r.rejected) for _, r in stream_of(spark, rows, "uid string, request_id long, at timestamp", tmp_path, lambda s: stateful.rate_limited(s, 60, 4), "append")}
    want, log = {}, {}
    for u, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        own = log[u] = [x for x in log.get(u, []) if (at - x).total_seconds() <= 60] + [at]
        want[i] = (len(own), len(own) > 4)
    assert got == want and any(x for _, x in want.values())


def test_running_stats_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), i, T0 + dt.timedelta(hours=5 * i), rng.choice([True, False, None])) for i in range(120)]
    rows = [r for r in rows if not (r[0] == "a" and r[2].day % 5 == 0)]
    newest = {}
    for n, r in stream_of(spark, rows, "uid string, attempt_id long, at timestamp, is_correct boolean", tmp_path, stateful.running_stats, "update"):
        newest[r.uid] = max(newest.get(r.uid, (-1, None)), (n, tuple(r)[1:]), key=lambda x: x[0])
    for uid in ("a", "b", ""):
        own = [r for r in rows if (r[0] or "") == uid]
        right, days = sum(bool(r[3]) for r in own), sorted({r[2].date() for r in own})
        streak = next(k for k in range(1, len(days) + 1) if k == len(days) or days[-k - 1] != days[-k] - dt.timedelta(days=1))
        assert newest[uid][1] == (len(own), right, 10 * right + 2 * (len(own) - right), streak, days[-1], [str(r[1]) for r in own[::-1][:20]])


def test_resolved_names(spark):
    """The best name that holds the asked one or lies in it, by comparing all of them."""
    rng = random.Random(3)
    words = ["a", "ab", "abc", "UPSC", "upsc ias", "ias", "SSC CGL", "CGL", "", "b c", "ssc  cgl tier", "x"]
    names = [(rng.choice(words), rng.choice([2020, 2021])) for _ in range(40)]
    papers = [(rng.choice(words), rng.choice([2020, 2021]), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 3), rng.choice([None, "archived", "x"])) for _ in range(60)]
    kinds = "asked string, exam_year int", "exam_name string, exam_year int, visible int, total int, upload_version int, lifecycle_status string"
    got = {(r.asked, r.exam_year): r.exam_name for r in upkeep.resolved_name(spark.createDataFrame(names, kinds[0]), spark.createDataFrame(papers, kinds[1])).collect()}
    tidy, known = (lambda s: " ".join(s.split())), {}
    for name, year, *rank, status in papers:
        if status != "archived":
            known[tidy(name), year] = max(known.get((tidy(name), year), []), rank)
    for asked, year in set(names):
        low = tidy(asked).lower()
        hits = [(name.lower() != low, [-x for x in rank], name) for (name, y), rank in known.items() if y == year and (low in name.lower() or name.lower() in low)]
        assert got[asked, year] == (min(hits)[2] if hits else tidy(asked))
