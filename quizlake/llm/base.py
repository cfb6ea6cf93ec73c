"""Shared pieces: scratch tables in the cluster's shared folder, word hashing, winnowing."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_OWN: list[str] = []
_SENT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and everything runs in this process (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quizlake-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs a re-read and no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            for path in self.paths.pop(name, []):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def prepare(spark: SparkSession) -> None:
    """Python workers get this package by Spark's file server; Arrow batches stay small where texts are long."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="quizlake-code-")
        context.addPyFile(shutil.make_archive(os.path.join(folder, os.path.basename(package)), "zip", os.path.dirname(package), os.path.basename(package)))
        atexit.register(shutil.rmtree, folder, True)
        _SENT.add(context.applicationId)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 2000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, with as many underscores in front as keep them apart from the columns of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def id_crc(column: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


class Memo(dict):
    """A bounded memo: word -> make(word).  It starts again when it is full."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def hasher():
    """words -> uint64 array of their xxHash64, by a memo."""
    import xxhash

    memo = Memo(xxhash.xxh64_intdigest)
    return lambda words: np.fromiter(map(memo.__getitem__, words), U64, len(words))


#: Everything but ASCII letters and digits becomes a blank; A-Z become small; bytes from 0x80 up stay.
ALNUM = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null has none."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; null has none."""
    return text.lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser in the manner of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * U64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest hash of every w consecutive ones, the last of equals; of fewer, the smallest of all."""
    if not len(g):
        return np.empty(0, np.int64)
    w = min(w, len(g))
    last = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(last)) + (w - 1) - last)


def root_of_package() -> str:
    return os.path.dirname(sys.modules[__package__].__file__)
