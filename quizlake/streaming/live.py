"""Structured Streaming forms of the live operators.

Stateless steps and plain aggregates are DataFrame operators, which run alike on streams and tables.  Where a decision
depends on earlier decisions of the same key, the state is a fixed number of values per key.
"""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import strip

# Seconds, requests without and with a login, answers kept.
WINDOW_S, ANONYMOUS, SIGNED_IN, RECENT = 60, 120, 300, 20
LATE = "10 minutes"
DAY = datetime.timedelta(days=1)


def with_correctness(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """attempts (a stream or a table) with is_correct judged by the questions; where those lack the row, what the client
    said holds (R3).  A question with several accepted answers takes any of them."""
    known = questions.select(F.col("id").alias("_id"), F.upper(strip("correct_answer")).alias("_one"), F.transform(F.coalesce("correct_answers", F.array().cast("array<string>")), lambda a: F.upper(strip(a))).alias("_many"))
    given = F.upper(strip("selected_answer"))
    judged = F.when(F.col("_id").isNull(), F.col("is_correct")).when(F.size("_many") > 0, F.array_contains("_many", given)).otherwise(given == F.col("_one"))
    return attempts.join(known, F.col("question_id") == F.col("_id"), "left").withColumn("is_correct", judged).drop("_id", "_one", "_many")


def admit(seen: list[float], now: float, limit: int, window: float = WINDOW_S) -> tuple[list[float], bool]:
    """The admitted times after a request, and whether it was admitted; rejected ones leave no trace."""
    seen = [s for s in seen if now - s <= window]
    return (seen, False) if len(seen) >= limit else ([*seen, now], True)


def _decided(rows: pd.DataFrame, seen: list[float]) -> tuple[list[float], list[bool]]:
    out = []
    for now, signed in zip(rows["at_s"], rows["signed_in"], strict=True):
        seen, ok = admit(seen, now, SIGNED_IN if signed else ANONYMOUS)
        out.append(ok)
    return seen, out


def _timed(requests: DataFrame, *more: str) -> DataFrame:
    return requests.select(*more, "client", "request_id", (F.unix_micros("at") / 1e6).alias("at_s"), F.coalesce("signed_in", F.lit(False)).alias("signed_in"))


def limited(requests: DataFrame) -> DataFrame:
    """request_id, admitted for a table of requests (client, request_id, at, signed_in) (R2).  A client's rows pass in
    order of time through one task, in batches: only its last admitted times are held."""

    def run(batches):
        client, seen = None, []
        for rows in batches:
            admitted = []
            for _, part in rows.groupby((rows["client"] != rows["client"].shift()).cumsum(), sort=False):
                if part["client"].iloc[0] != client:
                    client, seen = part["client"].iloc[0], []
                seen, ok = _decided(part, seen)
                admitted += ok
            yield pd.DataFrame({"request_id": rows["request_id"], "admitted": admitted})

    kind = dict(requests.dtypes)["request_id"]
    keyed = _timed(requests.withColumn("client", F.coalesce(F.col("client").cast("string"), F.lit("unknown"))))
    return keyed.repartition("client").sortWithinPartitions("client", "at_s", "request_id").mapInPandas(run, f"request_id {kind}, admitted boolean")


def limited_stream(requests: DataFrame) -> DataFrame:
    """The same for a stream, in the order of its micro-batches.  A client idle for two windows is forgotten, by the times
    of the requests; those that come later than LATE get no decision."""

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at_s", "request_id"])
        seen, ok = _decided(rows, seen)
        state.update((seen,))
        state.setTimeoutTimestamp(max(int((seen[-1] + 2 * WINDOW_S) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"request_id": rows["request_id"], "admitted": ok})

    kind = dict(requests.dtypes)["request_id"]
    return _timed(requests.withWatermark("at", LATE), "at").groupBy("client").applyInPandasWithState(step, f"request_id {kind}, admitted boolean", "seen array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def advance(state: tuple, day: datetime.date, correct: bool, entry: str) -> tuple:
    """(attempted, correct, streak, last day, recent entries) after one attempt: a day after the last adds to the streak,
    the same day keeps it, any other begins anew."""
    n, right, streak, last, recent = state
    if last != day:
        streak = streak + 1 if last is not None and day - last == DAY else 1
    return n + 1, right + int(correct), streak, day, [entry, *recent][:RECENT]


STATS = "uid string, attempted long, correct long, streak int, last_day date, recent array<string>"


def running_stats(attempts: DataFrame) -> DataFrame:
    """The newest statistics of each user who attempted something in a micro-batch."""

    def step(key, frames, state: GroupState):
        now = tuple(state.get) if state.exists else (0, 0, 0, None, [])
        now = (*now[:4], list(now[4]))
        for row in pd.concat(list(frames)).sort_values(["at", "attempt_id"]).itertuples():
            now = advance(now, row.at.date(), bool(row.is_correct), str(row.attempt_id))
        state.update(now)
        yield pd.DataFrame({"uid": [key[0]], "attempted": [now[0]], "correct": [now[1]], "streak": [now[2]], "last_day": [now[3]], "recent": [now[4]]})

    return attempts.select("uid", "at", "attempt_id", F.coalesce("is_correct", F.lit(False)).alias("is_correct")).groupBy("uid").applyInPandasWithState(step, STATS, STATS.removeprefix("uid string, "), "update", GroupStateTimeout.NoTimeout)


def flag_counts(flags: DataFrame, at_least: int = 3) -> DataFrame:
    """question_id, flags, hidden: one flag counts per user and question."""
    return flags.dropDuplicates(["question_id", "user_id"]).groupBy("question_id").agg(F.count("*").alias("flags")).withColumn("hidden", F.col("flags") >= at_least)


def resume(stream: DataFrame, path: str, checkpoint: str):
    """Writes what is new since the checkpoint, then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
