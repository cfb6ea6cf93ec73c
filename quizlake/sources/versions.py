"""Snapshots of a table as versions (S5, E7): each is a folder that is never written again, listed by a numbered log.

    <root>/data/<id>/       Parquet of one version
    <root>/log/<n>.json     entry n: version, label, kind, rows, files, bytes, digest, time

A version counts from the moment its entry gets its name, by a rename that fails if the name is taken: readers see the whole
version before or the whole version after, two writers never take one number, and a writer that dies leaves a folder that nothing lists.
Freezing labels the current version, restoring appends an entry that points to an older one, so nothing is copied.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset and everything runs in this process, one of
    our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="quizlake-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return f"file://{_OWN[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there; the files stay as long as the folder does."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Conflict(RuntimeError):
    """Another writer took the number."""


def digest(df: DataFrame) -> dict:
    """rows and a digest that doesn't depend on their order: the sum of two hashes of each row."""
    names = [F.col(f"`{c}`") for c in df.columns] or [F.lit(0)]
    sums = [F.sum(F.xxhash64(*names, F.lit(salt)).cast("decimal(20, 0)")) for salt in (1, 2)]
    n, a, b = df.agg(F.count("*"), *sums).first()
    return {"rows": n, "digest": f"{int(a or 0) % (1 << 64):016x}{int(b or 0) % (1 << 64):016x}"}


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, jvm = spark, root.rstrip("/"), spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), conf)
        self._fs.mkdirs(self._path(f"{self.root}/log"))

    # the log

    def _entry(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/log/{n:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode()) | {"n": n}
        finally:
            stream.close()

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/log")))
        return sorted(int(m[1]) for x in names if (m := re.fullmatch(r"(\d{10})\.json", x)))

    def _append(self, entry: dict, after: int) -> dict:
        text = json.dumps(entry | {"at": time.time()}).encode()
        temporary = self._path(f"{self.root}/log/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(text))
        stream.close()
        try:
            self._context.rename(temporary, self._path(f"{self.root}/log/{after + 1:010d}.json"), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(temporary, False)
            if self._fs.exists(self._path(f"{self.root}/log/{after + 1:010d}.json")):
                raise Conflict(f"entry {after + 1} is taken") from e
            raise
        return self._entry(after + 1)

    def current(self) -> dict | None:
        numbers = self.numbers()
        return self._entry(numbers[-1]) if numbers else None

    def labelled(self, label: str) -> dict:
        """The newest entry with this label."""
        for n in reversed(self.numbers()):
            if (entry := self._entry(n))["label"] == label:
                return entry
        raise KeyError(label)

    # versions

    def publish(self, df: DataFrame, label: str | None = None, expected: int | None = None) -> dict:
        """Writes df as the next version.  expected: the number that the writer has seen last; if it is no longer the last
        one, nothing changes and Conflict is raised."""
        numbers = self.numbers()
        last = numbers[-1] if numbers else 0
        if expected is not None and expected != last:
            raise Conflict(f"entry {last} came after {expected}")
        version = uuid.uuid4().hex
        where = f"{self.root}/data/{version}"
        df.write.parquet(where)
        summary = self._fs.getContentSummary(self._path(where))
        written = self.spark.read.schema(df.schema).parquet(where)
        return self._append({"kind": "publish", "version": version, "label": label, "files": summary.getFileCount(), "bytes": summary.getLength(), "schema": df.schema.json(), **digest(written)}, last)

    def _point(self, entry: dict, kind: str, label: str | None) -> dict:
        return self._append({k: v for k, v in entry.items() if k not in ("n", "at")} | {"kind": kind, "label": label}, self.numbers()[-1])

    def freeze(self, label: str) -> dict:
        """Gives the current version a label to come back to."""
        if (now := self.current()) is None:
            raise KeyError("nothing is published")
        return self._point(now, "freeze", label)

    def restore(self, label: str) -> dict:
        """Makes the version of a label the current one again."""
        return self._point(self.labelled(label), "restore", None)

    def read(self, entry: dict | None = None, verify: bool = False) -> DataFrame:
        """The rows of an entry, of the current one if none is given.  verify: compare rows and digest with the manifest."""
        from pyspark.sql.types import StructType

        entry = entry or self.current()
        if entry is None:
            raise KeyError("nothing is published")
        out = self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.root}/data/{entry['version']}")
        if verify and digest(out) != {k: entry[k] for k in ("rows", "digest")}:
            raise ValueError(f"version {entry['version']} is not what was published")
        return out

    def fresh(self, build: Callable[[], DataFrame], seconds: float, now: float | None = None) -> DataFrame:
        """The current version if it is younger than this, else build() published as the next one (S5).  A writer that comes
        second reads what the first has published."""
        entry = self.current()
        if entry is None or (time.time() if now is None else now) - entry["at"] > seconds:
            try:
                entry = self.publish(build(), expected=entry["n"] if entry else 0)
            except Conflict:
                entry = self.current()
        return self.read(entry)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that neither the last `keep` entries nor a label point to; returns how many."""
        entries = [self._entry(n) for n in self.numbers()]
        held = {e["version"] for e in entries[-keep:]} | {e["version"] for e in entries if e["label"]}
        gone = {e["version"] for e in entries} - held
        return sum(bool(self._fs.delete(self._path(f"{self.root}/data/{v}"), True)) for v in gone)
