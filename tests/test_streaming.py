"""The live operators, on tables and as streams over files."""

import datetime as dt
import random

from quizlake.streaming import live

T0 = dt.datetime(2024, 1, 1)


def requests(n=1500):
    rng = random.Random(3)
    return [(rng.choice(["a", "a", "a", "b"]), k, T0 + dt.timedelta(seconds=k // 5), k % 2 == 0) for k in range(n)]


def brute(rows):
    seen, out = {}, {}
    for client, k, at, signed in rows:
        past = [s for s in seen.get(client, []) if (at - s).total_seconds() <= live.WINDOW_S]
        out[k] = len(past) < (live.SIGNED_IN if signed else live.ANONYMOUS)
        seen[client] = past + [at] * out[k]
    return out


def stream(spark, df, tmp_path, files=1):
    df.repartition(files).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_limited(spark, tmp_path):
    rows = requests()
    df = spark.createDataFrame(rows, "client string, request_id long, at timestamp, signed_in boolean")
    want = brute(rows)
    assert not all(want.values())
    assert {r.request_id: r.admitted for r in live.limited(df).collect()} == want
    q = live.limited_stream(stream(spark, df, tmp_path)).writeStream.format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(60)
    assert {r.request_id: r.admitted for r in spark.table("limited").collect()} == want


def test_running_stats(spark, tmp_path):
    rows = [("u", k, T0 + dt.timedelta(days=d), k % 3 == 0) for k, d in enumerate([0, 0, 1, 2, 5, 6, 6])]
    df = spark.createDataFrame(rows, "uid string, attempt_id long, at timestamp, is_correct boolean")
    q = live.running_stats(stream(spark, df, tmp_path)).writeStream.format("memory").queryName("stats").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(60)
    [got] = spark.table("stats").collect()
    assert (got.attempted, got.correct, got.streak, got.last_day, got.recent) == (7, 3, 2, dt.date(2024, 1, 7), list("6543210"))


def test_flags_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("q", u) for u in "aabc"] + [("r", "a")], "question_id string, user_id string")
    src = stream(spark, df, tmp_path)
    q = live.flag_counts(src).writeStream.format("memory").queryName("flags").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("flags").collect()} == {("q", 3, True), ("r", 1, False)}
    for _ in range(2):  # the second run finds nothing new
        live.resume(src, str(tmp_path / "out"), str(tmp_path / "d")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 5
