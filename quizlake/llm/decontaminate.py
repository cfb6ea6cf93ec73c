"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of every 9 consecutive 5-grams.  Any 13 shared words hold 9 shared 5-grams, so both
sides keep the same one of them: no shared window can be missed.  Each kept fingerprint carries the words up to 8 before
and 8 after its 5-gram (their hashes), which is all that a window around it can reach.  Fingerprints of documents and
benchmark are joined; where two meet, the hit is extended over the words they carry, and every run of 13 or more equal
words is hit.  Items of fewer than 13 words have one fingerprint, their whole, and meet the documents' grams of that length.

Before the join a bitmap of BITS bits, a fixed size however large the benchmark is, lets through what may have a partner;
when it fills up, more rows are joined and nothing is lost.  A fingerprint that many documents hold is split by the skewed
join of adaptive execution.  Nothing of either side passes through the driver but that bitmap.

Null, empty or wordless texts have no words and are never contaminated.  Items without an id or words are ignored;
repeated items count once per id.  Repeated document rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import U64, Scratch, alnum_words, fresh, grams, hasher, mix, prepare, winnow

WINDOW, GRAM = 13, 5
KEEP = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM
REACH = GRAM + 2 * SIDE
BITS = 1 << 26
MARKS = "array<struct<key:long,at:int,size:int,around:binary>>"


def spelled(h: np.ndarray, size: int) -> np.ndarray:
    """Keys of the grams of `size` words; grams of other sizes have other keys."""
    return mix(grams(h, size) + U64(size) * U64(0x9E3779B97F4A7C15))


def around(h: np.ndarray, places: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For each place the words within reach of its gram, of the text that lies between lo and hi; 0 beyond its ends."""
    at = places[:, None] + np.arange(-SIDE, GRAM + SIDE)
    return np.where((at >= lo) & (at < hi), h[np.clip(at, 0, len(h) - 1)], U64(0))


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys that winnowing keeps of a text of at least WINDOW words."""
    places = winnow(grams(h, GRAM), KEEP)
    return places, spelled(h, GRAM)[places]


def _told(keys, places, sizes, context) -> list[dict]:
    return [{"key": int(k), "at": int(p), "size": int(n), "around": c} for k, p, n, c in zip(keys.view(np.int64), places, sizes, context, strict=True)]


def of_items(benchmark: DataFrame) -> DataFrame:
    """item, key, at, size, around: the fingerprints of the benchmark; size is 0 for those of items of WINDOW words or more."""

    def run(batches):
        hashed = hasher()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("item", "key", "at", "size", "around")}
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                h = hashed(alnum_words(text))
                if 0 < len(h) < WINDOW:
                    marks = _told(spelled(h, len(h)), [0], [len(h)], [b""])
                elif len(h):
                    places, keys = fingerprints(h)
                    marks = _told(keys, places, [0] * len(places), [c.tobytes() for c in around(h, places, 0, len(h))])
                else:
                    marks = []
                for m in marks:
                    out["item"].append(item)
                    for c in ("key", "at", "size", "around"):
                        out[c].append(m[c])
            yield pa.RecordBatch.from_arrays([pa.array(out[c], k) for c, k in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=list(out))

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item IS NOT NULL").distinct()
    return items.mapInArrow(run, "item string, key long, at int, size int, around binary").distinct()


def bitmap(items: DataFrame, bits: int) -> np.ndarray:
    """Which of `bits` classes of keys the benchmark has."""
    out = np.zeros(bits // 64 + 1, np.uint64)
    word = F.pmod("key", F.lit(bits))
    rows = items.select(word.alias("bit")).groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    out[np.asarray(rows.column("word"))] = np.asarray(rows.column("bits")).view(np.uint64)
    return out


def of_documents(docs: DataFrame, sent, bits: int, sizes: list[int]) -> DataFrame:
    """doc_id, n_words and the fingerprints (marks) that may have a partner."""

    def known(keys: np.ndarray) -> np.ndarray:
        bit = np.mod(keys.view(np.int64), bits).astype(np.uint64)
        return np.flatnonzero(sent.value[bit >> U64(6)] >> (bit & U64(63)) & U64(1))

    def run(batches):
        hashed = hasher()
        for batch in batches:
            words = [alnum_words(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(counts)
            h = hashed([x for w in words for x in w])
            marks: list[list[dict]] = [[] for _ in words]

            def add(places, keys, size, h=h, ends=ends, counts=counts, marks=marks):
                # a gram must lie within one text
                doc = np.searchsorted(ends, places, "right")
                inside = places + (size or GRAM) <= ends[doc]
                for p, k, d in zip(places[inside], keys[inside], doc[inside], strict=True):
                    begin = int(ends[d] - counts[d])
                    context = b"" if size else around(h, np.array([p]), begin, int(ends[d]))[0].tobytes()
                    marks[d] += _told(np.array([k]), [p - begin], [size], [context])

            if len(h) >= GRAM:
                places, keys = fingerprints(h)
                keep = known(keys)
                add(places[keep], keys[keep], 0)
            for size in sizes:
                keys = spelled(h, size)
                keep = known(keys)
                add(keep, keys[keep], size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(marks, KINDS)], ["doc_id", "n_words", "marks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, marks {MARKS}")


KINDS = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("around", pa.binary())]))


def _extended(batches):
    """Pairs of fingerprints to the item and the hit words: begin and end of each run of WINDOW equal words or more."""
    for batch in batches:
        size = np.asarray(batch.column("size"))
        row, item, at = np.asarray(batch.column("row")), batch.column("item").to_pylist(), np.asarray(batch.column("at"))
        out = [(int(row[i]), item[i], int(at[i]), int(at[i] + size[i])) for i in np.flatnonzero(size)]
        long = np.flatnonzero(size == 0)
        if len(long):
            take = lambda c: np.frombuffer(b"".join(batch.column(c).take(pa.array(long)).to_pylist()), np.uint64).reshape(-1, REACH)  # noqa: B023, E731
            x, y = take("around"), take("other")
            same = np.zeros((len(long), REACH + 2), bool)
            same[:, 1:-1] = (x == y) & (x != 0)
            for i, s in zip(long, same, strict=True):
                edges = np.flatnonzero(s[1:] != s[:-1])
                out += [(int(row[i]), item[i], int(at[i]) - SIDE + int(a), int(at[i]) - SIDE + int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= WINDOW]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["row", "item", "begin", "end"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each row of docs (doc_id, text), with what benchmark (item_id, text) has in common with it."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    items = scratch.table(of_items(benchmark), "items")
    sizes = sorted(r[0] for r in items.where("size > 0").select("size").distinct().collect())  # at most 12
    sent = spark.sparkContext.broadcast(bitmap(items, bits))
    rows = scratch.table(of_documents(docs, sent, bits, sizes).withColumn("row", F.monotonically_increasing_id()), "rows")
    marks = rows.where(F.size("marks") > 0).select("row", F.explode("marks").alias("m")).select("row", "m.*")
    met = marks.join(items.select("item", F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("around").alias("other")), (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")))
    hits = scratch.table(met.select("row", "item", "at", "size", "around", "other").mapInArrow(_extended, "row long, item string, begin long, end long").distinct(), "hits")
    # the union of a document's runs: each run adds what lies beyond the furthest end before it
    runs = hits.groupBy("row", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), F.coalesce(before, F.lit(0))))
    n_hit = runs.withColumn("new", new).groupBy(F.col("row").alias("_row")).agg(F.sum("new").alias("n_hit"))
    found = hits.groupBy(F.col("row").alias("_of")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    out = rows.select("row", "doc_id", "n_words").join(n_hit, F.col("row") == F.col("_row"), "left").join(found, F.col("row") == F.col("_of"), "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated.alias("contaminated"), "items")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; the columns stay.  A null id is judged like any other."""
    (bad,) = fresh(docs, "_bad")
    found = decontaminate(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(bad)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found[bad]), "left_anti")
