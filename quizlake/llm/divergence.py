"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

Terms are runs of letters and characters beyond ASCII, with A-Z lower-cased.  A language keeps the terms of at least MIN_DOCS
of its documents: V terms.  Each group (lang, source) gives a term the integer p = 1 + floor(SCALE * (n + 1) / (N + V)), where
n counts the term in the group and N sums these counts; f(p, q) = floor((p - q)^2 / q).

Method: an inverted index lists for each (lang, term) the sources that hold it.  A pair of sources starts at V * f(p0, q0), what
it would have if no term occurred (p0, q0: the values of count 0), and the index only adds corrections:

- a term of one source alone changes f(p0, q0) to f(p, q0); it depends on the count alone, so the terms of a group are
  first counted by their count, and a row stands for all terms of that count;
- a term of both adds f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) to that, summed over the postings that two sources share;
  corrections of 0 are left out.

Everything is integer arithmetic: p by decimals of 38 digits, the rest by longs, whose sums stay below (SCALE + V)^2 (a sum
beyond a long raises an error under Spark's ANSI mode and never wraps unseen).

Null text, lang and source read as ''.  Repeated rows count as often as they occur, ids aren't used, other columns are ignored.
A language without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs.  Ties: value
descending, then the item by its UTF-8 bytes.  No documents give no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, prepare

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Counted terms that a task keeps before it sends them on, and groups up to which their table is broadcast.
HELD, BROADCAST = 400_000, 100_000
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(LETTERS).split() if text else []


def _counted(batches):
    held: dict[tuple, dict[bytes, list[int]]] = {}
    size = 0

    def sent():
        for (lang, source), own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array([x[0] for x in own.values()], pa.int64()), pa.array([x[1] for x in own.values()], pa.int64())], schema=COUNTED)

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            found = Counter(terms(text))
            if not found:
                continue
            own = held.setdefault((lang, source), {})
            size -= len(own)
            for term, n in found.items():
                if (x := own.get(term)) is None:
                    own[term] = [n, 1]
                else:
                    x[0] += n
                    x[1] += 1
            size += len(own)
            if size >= HELD:
                yield from sent()
                held.clear()
                size = 0
    yield from sent()


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)) of long columns; null where the divisor is 0."""
    return F.expr(f"1L + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0)) DIV nullif(CAST({total} + {kept} AS DECIMAL(20, 0)), 0)")


def f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) DIV {q})"


def index(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total, posting (source, n): the inverted index of the terms that a language keeps."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posting"))
    return lists.where(F.col("docs") >= min_docs).drop("docs")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank; see above."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    lists = scratch.table(index(docs, min_docs), "index")
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    entries = lists.select("lang", "term", "total", F.inline("posting"))
    held = entries.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    kept = lists.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("all"))
    stats = groups.join(held, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["own", "kept", "all"])
    stats = scratch.table(stats.withColumn("p0", probability("0L", "own", "kept")), "groups")
    near = F.broadcast if stats.count() <= BROADCAST else (lambda df: df)

    entries = entries.join(near(stats), ["lang", "source"])
    entries = entries.select("lang", "term", "source", "n", "p0", probability("n", "own", "kept").alias("p"), probability("total", "`all`", "kept").alias("q"))
    entries = scratch.table(entries, "entries")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    other = stats.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    start = stats.join(near(other), "lang").where(apart).select("lang", "source", "item", F.coalesce(F.expr(f"kept * {f('p0', 'q0')}"), F.lit(0)).alias("value"))
    alike = entries.groupBy("lang", "source", "n", "p0", "p").agg(F.count("*").alias("k")).join(near(other), "lang").where(apart)
    alike = alike.select("lang", "source", "item", F.expr(f"k * ({f('p', 'q0')} - {f('p0', 'q0')})").alias("to"), F.expr(f"k * ({f('q0', 'p')} - {f('q0', 'p0')})").alias("fro"))
    second = entries.select("lang", "term", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("p").alias("q"))
    both = entries.drop("q").join(second, ["lang", "term"]).where(F.col("source") < F.col("item"))
    change = lambda p, p0, q, q0: F.expr(f"{f(p, q)} - {f(p, q0)} - {f(p0, q)} + {f(p0, q0)}")
    both = both.select("lang", "source", "item", change("p", "p0", "q", "q0").alias("to"), change("q", "q0", "p", "p0").alias("fro")).where("to <> 0 OR fro <> 0")
    moved = alike.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("to").alias("to"), F.sum("fro").alias("fro"))
    moved = moved.select("lang", F.inline(F.array(F.struct("source", "item", F.col("to").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("fro").alias("value")))))
    pairs = start.unionByName(moved).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))

    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).unionAll(over.withColumn("part", F.lit("term")).select(out))
