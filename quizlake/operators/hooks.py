"""Row functions that call a model (V4): batched, cached by content, tried again, with rules where no answer comes.

A hook is a Python function from a list of texts to a list of answers of the same length, None where it has none for a text.  It is
called in tasks, with BATCH texts at most, for each different text once; what the cache knows never reaches it.  The cache is
a table (key, answer), which the caller keeps; the key is the MD5 of the hook's version and the text, so that a new version asks
anew.  A call that raises counts as one without answers; texts without an answer are tried again, TRIES times in all, in batches of
half the size each time and one by one in the last, and then take what the rules say.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from ..sources.versions import written

BATCH, TRIES = 25, 3
Hook = Callable[[list[str]], list[str | None]]


def cache_key(text, version: str) -> Column:
    return F.md5(F.concat(F.lit(f"{version}\n"), F.coalesce(col(text), F.lit(""))).cast("binary"))


def asked(texts: DataFrame, hook: Hook, batch: int) -> DataFrame:
    """key, text, answer, problem for texts (key, text)."""

    def run(batches):
        for part in batches:
            for a in range(0, part.num_rows, batch):
                rows = part.slice(a, batch)
                given, problem = [None] * rows.num_rows, None
                try:
                    got = hook(rows.column("text").to_pylist())
                    if len(got) != rows.num_rows:
                        raise ValueError(f"{len(got)} answers to {rows.num_rows} texts")
                    given = [None if x is None else str(x) for x in got]
                except Exception as e:  # whatever a model's client raises
                    problem = f"{type(e).__name__}: {e}"[:200]
                told = [problem if x is None and problem else "no answer" if x is None else None for x in given]
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("text"), pa.array(given, pa.string()), pa.array(told, pa.string())], ["key", "text", "answer", "problem"])

    return texts.mapInArrow(run, "key string, text string, answer string, problem string")


def answered(rows: DataFrame, text: str, hook: Hook, version: str, cache: DataFrame | None = None, fallback: Column | None = None, batch: int = BATCH, tries: int = TRIES) -> tuple[DataFrame, DataFrame]:
    """rows with answer, answer_source (cache, model or rules) and answer_problem, and the cache with what is new.  A null text is asked
    as an empty one.  fallback: a column of rows; null where the rules say nothing."""
    keyed = rows.withColumn("_key", cache_key(text, version))
    known = (cache if cache is not None else rows.sparkSession.createDataFrame([], "key string, answer string")).where("answer IS NOT NULL").groupBy("key").agg(F.max("answer").alias("answer"))
    wanted = keyed.select(F.col("_key").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    open_ = wanted.join(known, "key", "left_anti")
    new, problems = None, None
    for k in range(tries):
        got = written(asked(open_, hook, 1 if k and k == tries - 1 else max(1, batch >> k)), "answers")
        some = got.where("answer IS NOT NULL").select("key", "answer")
        new = some if new is None else new.unionByName(some)
        problems = got.where("answer IS NULL").select("key", "problem")
        if problems.isEmpty():
            break
        open_ = got.where("answer IS NULL").select("key", "text")
    told = known.withColumn("_from", F.lit("cache")).unionByName(new.withColumn("_from", F.lit("model")))
    out = keyed.join(told.select(F.col("key").alias("_key"), F.col("answer").alias("_answer"), "_from"), "_key", "left").join(problems.select(F.col("key").alias("_key"), F.col("problem").alias("answer_problem")), "_key", "left")
    rules = fallback if fallback is not None else F.lit(None).cast("string")
    source = F.when(F.col("_from").isNotNull(), F.col("_from")).when(rules.isNotNull(), "rules")
    out = out.withColumns({"answer": F.coalesce("_answer", rules), "answer_source": source}).drop("_key", "_answer", "_from")
    return out, known.unionByName(new)
