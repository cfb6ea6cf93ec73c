"""Operators with state of their own, as stateful processors (R1, R4): state variables by key, timers that end them.

Both need a state store with column families:

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

Rows of a key within a micro-batch are taken in order of (at, id); batches come in the order in which the source gives them.  Null keys are
a key of their own, the empty one.
"""

from __future__ import annotations

import datetime
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Seconds and requests of a user, attempts kept, points.
WINDOW_S, MOST, RECENT, RIGHT, WRONG = 600, 200, 20, 10, 2
LATE = "10 minutes"
DECISIONS = "uid string, request_id long, requests long, rejected boolean"
STATS = "uid string, attempted long, correct long, xp long, streak long, last_day date, recent array<string>"


class SlidingLog(StatefulProcessor):
    """Times of the requests of the last `seconds`, rejected ones too; a request is rejected if with it there are more than `most`."""

    def __init__(self, seconds: int, most: int):
        self.micros, self.most = seconds * 1_000_000, most

    def init(self, handle) -> None:
        self.handle, self.times = handle, handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues):
        log = deque(x[0] for x in self.times.get())
        for frame in [pd.concat(list(rows)).sort_values(["at_us", "request_id"])]:
            counts = []
            for now in frame["at_us"].tolist():
                while log and log[0] < now - self.micros:
                    log.popleft()
                log.append(now)
                counts.append(len(log))
            self.times.put([(x,) for x in log])
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            # a key that stays idle for a window has nothing left to count
            self.handle.registerTimer(max((log[-1] + self.micros) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
            yield pd.DataFrame({"uid": key[0], "request_id": frame["request_id"].to_numpy(), "requests": counts, "rejected": [n > self.most for n in counts]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.times.clear()
        return iter(())


class RunningStats(StatefulProcessor):
    """Counts, points, streak of days and the newest attempts of a user; an attempt on the day after the last one adds to the streak, one on
    the same day keeps it, any other begins anew."""

    def init(self, handle) -> None:
        self.numbers = handle.getValueState("numbers", "attempted long, correct long, xp long, streak long, last_day date")
        self.newest = handle.getListState("newest", "entry string")

    def handleInputRows(self, key, rows, timerValues):
        n, right, xp, streak, last = self.numbers.get() if self.numbers.exists() else (0, 0, 0, 0, None)
        recent = deque((x[0] for x in self.newest.get()), RECENT)
        frame = pd.concat(list(rows)).sort_values(["at_us", "attempt_id"])
        for us, attempt, correct in zip(frame["at_us"].tolist(), frame["attempt_id"].tolist(), frame["is_correct"].tolist(), strict=True):
            day = datetime.date(1970, 1, 1) + datetime.timedelta(days=us // 86_400_000_000)
            if day != last:
                streak, last = (streak + 1 if last is not None and (day - last).days == 1 else 1), day
            n, right, xp = n + 1, right + bool(correct), xp + (RIGHT if correct else WRONG)
            recent.append(str(attempt))
        self.numbers.update((n, right, xp, streak, last))
        self.newest.put([(x,) for x in recent])
        yield pd.DataFrame({"uid": [key[0]], "attempted": [n], "correct": [right], "xp": [xp], "streak": [streak], "last_day": [last], "recent": [list(recent)[::-1]]})


def rate_limited(requests: DataFrame, seconds: int = WINDOW_S, most: int = MOST) -> DataFrame:
    """uid, request_id, requests, rejected for a stream of requests (uid, request_id, at) (R1).  Requests that come later than LATE are not
    decided; a user who is idle for a window is forgotten."""
    rows = requests.withWatermark("at", LATE).select(F.coalesce(F.col("uid").cast("string"), F.lit("")).alias("uid"), "request_id", "at", F.unix_micros("at").alias("at_us"))
    return rows.groupBy("uid").transformWithStateInPandas(SlidingLog(seconds, most), DECISIONS, "Append", "EventTime")


def running_stats(attempts: DataFrame) -> DataFrame:
    """The statistics of each user after each micro-batch with attempts of theirs (R4): attempts (uid, attempt_id, at, is_correct)."""
    rows = attempts.select(F.coalesce(F.col("uid").cast("string"), F.lit("")).alias("uid"), "attempt_id", F.unix_micros("at").alias("at_us"), F.coalesce("is_correct", F.lit(False)).alias("is_correct"))
    return rows.groupBy("uid").transformWithStateInPandas(RunningStats(), STATS, "Update", "None")
