"""Pages of a site, exported polls, paged exports, versions, ranks and the store's last step."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from quizlake.operators import learner, upkeep
from quizlake.sources import exports, versions
from quizlake.sources.webpages import question_pages

BASE = "https://q.example.org"
NAME = "Who wrote this long book?"
OPTIONS = "".join(f"<p>{x}. text {x}</p>" for x in "ABCD")


def ld(data) -> str:
    return f'<script type="application/ld+json">{data if isinstance(data, str) else json.dumps(data)}</script>'


def asked(name=NAME, letters="ABCD", answer="(B) it is", kind="QAPage"):
    return ld({"@type": kind, "mainEntity": {"name": name, "text": name + "".join(f"\n{x}) opt {x}" for x in letters), "acceptedAnswer": {"text": answer}}})


PAGES = {
    "whole": asked(), "list": asked(kind=["Thing", "QAPage"]), "other type": asked(kind="Thing"), "malformed": ld("{not json") + asked(), "array": ld([1, 2]) + asked(), "script": asked(answer="") + '{"mcq" : {"a":1,"q-12": 3}}', "no number": asked(answer="") + '"mcq":{"q-1":7}', "two blocks": asked(letters="AB") + asked(name="short", letters="BCD", answer="(A)"),
    "text": f"<style>A. no</style><h1>{NAME} &amp; when</h1>{OPTIONS}<b>Correct answer: C</b>", "text answer": asked(answer="none") + "<p>correct : D", "three": asked(letters="ABC") + "<p>A. x", "fallback": asked(letters="AB") + OPTIONS, "topic": asked() + ld({"@type": "Quiz", "about": {"name": "Books"}}) + ld({"@type": "LearningResource", "about": {"name": "ab"}}), "nothing": "<p>hello", "null": None,
}


def test_question_pages(spark):
    rows = [(k, f"{BASE}/ias/2001/world-affairs/{i}", h) for i, (k, h) in enumerate(PAGES.items())] + [("path", f"{BASE}/ias/2001/x", asked()), ("year", f"{BASE}/ias/x/y/z", asked()), ("no url", None, asked())]
    got = {r.k: r for r in question_pages(spark.createDataFrame(rows, "k string, url string, html string"), BASE, {"ias": "UPSC IAS"}).collect()}
    assert {k: r.correct_answer for k, r in got.items()} == {"whole": "B", "list": "B", "malformed": "B", "array": "B", "script": "D", "two blocks": "B", "text": "C", "text answer": "D", "fallback": "B", "topic": "B"}
    assert got["whole"].option_c == "opt C" and got["fallback"].option_c == "text C" and got["two blocks"].option_b == "opt B" and got["two blocks"].question_text == NAME
    assert got["text"].question_text == f"{NAME} & when" and got["text"].topic == got["text"].subject == "World Affairs" and got["topic"].topic == "Books" and got["whole"].exam_name == "UPSC IAS" and got["whole"].exam_year == 2001
    import hashlib

    assert got["whole"].question_hash == hashlib.sha256(f"upsc ias_2001_{NAME.lower()}".encode()).hexdigest()


def message(i, text="Which of these is it?", options="abcd", right=1, date="2020-01-02T03:04:05"):
    return {"id": i, "date": date, "poll": {"question": {"text": text}, "answers": [{"text": {"text": x}} for x in options]}, "results": None if right is None else [{"correct": k == right} for k in range(len(options))]}


def put(folder, channel, name, *messages):
    os.makedirs(f"{folder}/channel={channel}", exist_ok=True)
    with open(f"{folder}/channel={channel}/{name}", "w") as f:
        f.writelines((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages)


def test_polls(spark, tmp_path):
    exports.register(spark)
    put(tmp_path, "one", "a.json", message(1), message(2, "too short"[:8]), message(3, options="abc"), message(4, right=None), message(5, options="abcde", right=4), {"id": 6, "text": "no poll"}, "{broken", message(7, "In 2019 or in 1999, which of these?"), message(8, "In 1980 it was which of these?", date=None), {"id": "x", "poll": {}}, message(9, "In 2030 it will be which one?"))
    put(tmp_path, "two", "a.json", message(1, "Another one in twain?", right=3))
    read = lambda: spark.read.format("polls").load(str(tmp_path))
    got = {(r.exam_name, r.source_pdf[-5:]): (r.correct_answer, r.exam_year, r.option_d) for r in exports.poll_questions(read(), {"one": "E1", "two": "E2"}).collect()}
    assert got == {("E1", "one/1"): ("B", 2020, "d"), ("E1", "one/7"): ("B", 2019, "d"), ("E1", "one/8"): ("B", 0, "d"), ("E1", "one/9"): ("B", 2020, "d"), ("E2", "two/1"): ("D", 2020, "d")}
    assert read().where("channel = 'two'").count() == 1 and read().where("channel = 'two' AND message_id > 1").count() == 0 and read().rdd.getNumPartitions() == 2
    assert read().where("channel IN ('two')").rdd.getNumPartitions() == 1  # the filter leaves files out


def test_polls_as_a_stream(spark, tmp_path):
    exports.register(spark)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))

    def run():
        polls = exports.poll_questions(spark.readStream.format("polls").load(source), {"one": "E", "two": "E"})
        polls.writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.source_pdf[-5:] for r in spark.read.parquet(out).collect())

    put(source, "one", "2020.json", message(1))
    assert run() == ["one/1"]
    put(source, "one", "2021.json", message(2))
    put(source, "two", "2019.json", message(1))
    assert run() == ["one/1", "one/2", "two/1"] == run()


@pytest.mark.parametrize("pages, rows", [({0: 3, 1: 3, 2: 1, 3: 3}, 7), ({0: 3, 1: 3}, 6), ({0: 3, 2: 3}, 3), ({1: 3}, 0), ({0: 2, 1: 3}, 2)])
def test_paged_scan(spark, tmp_path, pages, rows):
    for n, k in pages.items():
        (tmp_path / f"page-{n}.json").write_text("".join(json.dumps({"id": n * 10 + i}) + "\n" for i in range(k)))
    assert exports.paged_scan(spark, str(tmp_path), "id long", 3).count() == rows


def test_versions(spark, tmp_path):
    store, rows = versions.Versions(spark, f"file://{tmp_path}/s"), spark.range(100).withColumn("x", F.col("id") % 7)
    with pytest.raises(KeyError):
        store.read()
    first = store.publish(rows, "a")
    assert first["rows"] == 100 and first["n"] == 1 and store.read(verify=True).count() == 100
    assert versions.digest(rows.repartition(5)) == versions.digest(rows) != versions.digest(rows.withColumn("x", F.col("x") + 1))
    store.publish(rows.limit(10))
    store.freeze("b")
    assert store.read().count() == 10 and store.read(store.labelled("a")).count() == 100
    with pytest.raises(versions.Conflict):
        store.publish(rows, expected=1)
    assert store.restore("a")["n"] == 4 and store.read(verify=True).count() == 100
    for i in range(3):
        store.publish(spark.range(i))
    assert store.vacuum(1) == 2 and store.read().count() == 2 and store.read(store.labelled("b")).count() == 10
    broken = store.labelled("a")
    name = next(x for x in os.listdir(f"{tmp_path}/s/data/{broken['version']}") if x.endswith(".parquet"))
    spark.range(1).withColumn("x", F.lit(1).cast("long")).coalesce(1).write.parquet(f"{tmp_path}/other")
    with open(f"{tmp_path}/s/data/{broken['version']}/{name}", "wb") as f:
        f.write(next((tmp_path / "other").glob("*.parquet")).read_bytes())
    os.remove(f"{tmp_path}/s/data/{broken['version']}/.{name}.crc")
    with pytest.raises(ValueError, match="not what was published"):
        store.read(broken, verify=True)


def test_one_number_has_one_writer(spark, tmp_path):
    stores, got = [versions.Versions(spark, f"file://{tmp_path}/s") for _ in range(4)], []

    def write(s):
        try:
            got.append(s.publish(spark.range(5), expected=0)["n"])
        except versions.Conflict:
            got.append(None)

    threads = [threading.Thread(target=write, args=(s,)) for s in stores]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert got.count(1) == 1 and got.count(None) == 3 and stores[0].numbers() == [1]


def test_fresh_snapshot(spark, tmp_path):
    store, built = versions.Versions(spark, f"file://{tmp_path}/s"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert [store.fresh(build, 100).count(), store.fresh(build, 100).count(), store.fresh(build, 100, now=store.current()["at"] + 101).count()] == [1, 1, 2]


def test_ranks_hold_when_partitions_are_coalesced(spark, tmp_path):
    """Some 10^5 users under a small advisory size: every rank from 1 to n, no row lost, in the right order."""
    n, keys = 300_000, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.shuffle.partitions": "64"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(n).select("id", (F.xxhash64("id") % 5000).alias("score"), F.repeat(F.lit("x"), 64).alias("wide"))
        learner.ranked(df, [F.desc("score"), F.asc("id")]).write.parquet(f"{tmp_path}/r")
        r = spark.read.parquet(f"{tmp_path}/r")
        assert r.agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank")).first() == (n, n, 1, n)
        by_rank = r.select("rank", "score", "id").toPandas().sort_values("rank")
        assert by_rank[["score", "id"]].values.tolist() == sorted(by_rank[["score", "id"]].values.tolist(), key=lambda x: (-x[0], x[1]))
        a = spark.range(n // 3).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit("E").alias("exam"), (F.col("id") % 3 == 0).alias("is_correct"), F.timestamp_seconds(F.col("id") % 1000).alias("at"))
        learner.leaderboard(a).write.parquet(f"{tmp_path}/b")
        assert spark.read.parquet(f"{tmp_path}/b").agg(F.count("*"), F.count_distinct("rank"), F.max("rank")).first() == (n // 3,) * 3
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_store_of_a_run(spark):
    kind = "id int, exam_name string, exam_year int, question_number int, question_text string, option_a string, option_b string, option_c string, option_d string, correct_answer string, question_type string, topic string, needs_review boolean, has_image boolean, image_url string, structural_status string, is_active boolean, question_hash string, position int"
    row = lambda i, exam="E", number=1, text="Which of these is the one?", answer="A", review=False, status="valid", active=False, hash="h": (i, exam, 2020, number, text, "a", "b", "c", "d", answer, "MCQ", None, review, False, None, status, active, hash, i)
    old = spark.createDataFrame([row(1, hash="h1"), row(2, review=True, hash="h2"), row(3, status=None, hash="h3"), row(4, text="too short", hash="h4"), row(5, answer="E", hash="h5"), row(6, number=None, hash="h6"), row(7, exam="F", hash="h7"), row(8, active=True, text="x", hash="h8")], kind)
    assert {r.id: r.is_active for r in upkeep.activated(old, old.where("exam_name = 'E'")).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: True}
    new = spark.createDataFrame([row(10, number=5, active=None), row(11, number=None, text="No number has this one here", active=None)], kind)
    out = {r.id: r for r in upkeep.stored(new, old).collect()}
    assert set(out) == set(range(1, 9)) | {10, 11} and out[10].is_active and not out[11].is_active and out[1].is_active and not out[7].is_active
    again = spark.createDataFrame([row(20, number=5, text="Which of these is the one?", answer="B", active=None)], kind)
    table = upkeep.stored(new, old)
    kept = {r.id for r in upkeep.stored(again, table).collect()}
    assert 10 in kept and 20 not in kept  # reviewed and shown: locked
    assert {r.id for r in upkeep.stored(again, table, force=True).collect()} == (kept - {10}) | {20}
