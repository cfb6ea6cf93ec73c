"""Reading of tables and JSON artifacts; snapshots are versions (versions.py).  Paging is Spark's: a scan reads all splits of a table, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A whole Parquet table, or those of the columns that it has."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def lookup(df: DataFrame, key, column: str = "id") -> DataFrame:
    """The row of a key, at most one (S3); the filter reaches the scan."""
    return df.where(F.col(column) == key).limit(1)


def json_artifact(spark: SparkSession, folder: str, name: str = "") -> DataFrame:
    """The named JSON file of a folder, or the one changed last, by name if several were (S6).  A folder in `name` is ignored."""
    if name:
        return spark.read.option("multiLine", True).json(f"{folder.rstrip('/')}/{name.replace(chr(92), '/').rsplit('/', 1)[-1]}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "modificationTime")
    newest = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    if newest is None:
        raise FileNotFoundError(f"no JSON files in {folder}")
    return spark.read.option("multiLine", True).json(newest["path"])
