"""Exported quiz polls as a Spark data source (S8), and tables exported page by page.

A folder holds JSON lines, a message each, in files `channel=<name>/<file>.json`, named so that later ones sort after earlier ones.
The folder must be one that driver and executors share.  After register(spark):

    spark.read.format("polls").load(folder)         one partition a file, filters on channel leave files out
    spark.readStream.format("polls").load(folder)   offsets are the last file of each channel

Messages without a poll are left out, malformed lines too; rows are sent on in batches, so files may be long.
"""

from __future__ import annotations

import json
import os
import sys
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from ..functions.text import strip

SCHEMA = "channel string, message_id long, sent_at string, question string, options array<string>, correct array<boolean>"
ARROW = pa.schema([("channel", pa.string()), ("message_id", pa.int64()), ("sent_at", pa.string()), ("question", pa.string()), ("options", pa.list_(pa.string())), ("correct", pa.list_(pa.bool_()))])
BATCH = 1000
# Fixed values.
LEAST_QUESTION, OPTIONS, HASHED, PAGE = 10, 4, 120, 1000
YEARS = (1990, 2025)
YEAR = r"(?U)\b(20\d{2}|19\d{2})\b"


def _local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def files(folder: str) -> dict[str, list[str]]:
    """The files of each channel, in order of their names."""
    out = {}
    for name in sorted(os.listdir(folder)):
        if name.startswith("channel="):
            own = sorted(x for x in os.listdir(os.path.join(folder, name)) if x.endswith(".json") and x[0] not in "._")
            out[unquote(name.removeprefix("channel="))] = [os.path.join(folder, name, x) for x in own]
    return out


def _text(x) -> str:
    """A text, or the text within an object of that name, as exports write it."""
    while isinstance(x, dict):
        x = x.get("text")
    return "" if x is None else str(x)


class File(InputPartition):
    def __init__(self, channel: str, path: str):
        self.channel, self.path = channel, path


def _rows(channel: str, path: str):
    with open(path, encoding="utf-8", errors="replace") as lines:
        for line in lines:
            try:
                message = json.loads(line)
                poll = message["poll"]
                yield channel, int(message["id"]), message.get("date"), _text(poll.get("question")), [_text(a) for a in poll.get("answers") or []], [bool(r.get("correct")) for r in (message.get("results") or [])]
            except (ValueError, KeyError, TypeError, AttributeError):
                continue


def _batches(part: File):
    held: list[tuple] = []
    for row in _rows(part.channel, part.path):
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


class PollReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.channels = folder, None

    def pushFilters(self, filters):
        """Takes filters on the channel; the rest is left to Spark."""
        for x in filters:
            wanted = {x.value} if isinstance(x, EqualTo) else set(x.value) if isinstance(x, In) else None
            if wanted is not None and x.attribute == ("channel",):
                self.channels = wanted if self.channels is None else self.channels & wanted
            else:
                yield x

    def partitions(self):
        return [File(c, p) for c, paths in files(self.folder).items() if self.channels is None or c in self.channels for p in paths]

    def read(self, partition: File):
        return _batches(partition)


class PollStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {c: os.path.basename(paths[-1]) for c, paths in files(self.folder).items() if paths}

    def partitions(self, start: dict, end: dict):
        return [File(c, p) for c, paths in files(self.folder).items() for p in paths if start.get(c, "") < os.path.basename(p) <= end.get(c, "")]

    def read(self, partition: File):
        return _batches(partition)


class PollExports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "polls"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        return _local(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return PollReader(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PollStream(self._folder())


def exam_year(question, sent_at) -> Column:
    """The first year that the question names, if it is one of YEARS; else that of the message, else 0."""
    named = F.nullif(F.regexp_extract(question, YEAR, 1), F.lit("")).try_cast("int")
    return F.coalesce(F.when(named.between(*YEARS), named), F.year(F.try_to_timestamp(sent_at)), F.lit(0))


def poll_questions(polls: DataFrame, exams: dict[str, str]) -> DataFrame:
    """Questions out of the quiz polls of known channels (a stream or a table): a question long enough, four options or more (the
    first four count) and an answer told among these."""
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in exams.items() for x in kv)), F.col("channel"))
    place = F.array_position("correct", F.lit(True)).cast("int")
    rows = polls.withColumns({"exam_name": name, "question_text": strip("question"), "_place": place})
    rows = rows.where(F.col("exam_name").isNotNull() & (F.length("question_text") >= LEAST_QUESTION) & (F.size("options") >= OPTIONS) & F.col("_place").between(1, OPTIONS))
    said = strip(F.lower(F.concat("exam_name", F.lit("_"), F.substring("question_text", 1, HASHED))))
    return rows.select(
        "question_text", *(strip(F.col("options")[i]).alias(f"option_{x}") for i, x in enumerate("abcd")), F.substring(F.lit("ABCD"), F.col("_place"), F.lit(1)).alias("correct_answer"), "exam_name", exam_year("question_text", "sent_at").alias("exam_year"),
        F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("message_id").cast("string")).alias("source_pdf"), F.sha2(said.cast("binary"), 256).alias("question_hash"),
    )


def paged_scan(spark: SparkSession, folder: str, schema: str, size: int = PAGE) -> DataFrame:
    """The rows of a table exported as JSON lines in files page-<n>.json, n from 0, of `size` rows (S1).  The scan ends with the first page
    that is shorter, or before the first that is missing; what lies beyond is left from an earlier export.  Any file
    system that Spark reads will do."""
    page = F.regexp_extract(F.col("_metadata.file_name"), r"page-(\d+)\.json$", 1).cast("long")
    rows = spark.read.schema(schema).json(f"{folder.rstrip('/')}/page-*.json").withColumn("_page", page)
    counts = rows.groupBy("_page").agg(F.count("*").alias("n"))
    ends = counts.join(counts.select((F.col("_page") - 1).alias("_page"), F.lit(True).alias("_next")), "_page", "left")
    last = ends.agg(F.min(F.when((F.col("n") < size) | F.col("_next").isNull(), F.col("_page"))).alias("_last"), F.min("_page").alias("_first"))  # one row
    return rows.join(F.broadcast(last.where("_first = 0")), F.col("_page") <= F.col("_last")).drop("_page", "_last", "_first")


def register(spark: SparkSession) -> None:
    """Makes the format `polls` known; executors need not have this package."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PollExports)
