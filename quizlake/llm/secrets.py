"""Secret scan [native]: patterns, and character Markov models of random strings and ordinary identifiers.

The base kinds are found by pattern.  The method adds spans of kind markov: runs of 20 or more of [A-Za-z0-9+/_=-] that
hold a letter and a digit, touch no base span and whose mean log-likelihood ratio per character, between a first-order model
of random strings and one of identifiers, is above THRESHOLD.  Without a digit they need two changes from small letters to
capitals and a ratio above LETTERS, since the model knows no words but those of identifiers.  Of a run that is no secret as
a whole, parts of 20 or more between "/", "_", "=" and "-" are judged in the same way, so that a path before a secret
doesn't hide it.  Both models are trained from labelled samples
(value, random); default_samples() makes them by rule.  The alphabet bounds the model to 80 x 80 numbers; it is all that
reaches the driver.

Positions are code points, ends exclusive.  A pattern's matches come from regexp_extract_all and the gaps between them from
split, which agree since both go leftmost without overlap; running sums of their lengths give the positions.
Null and empty texts have no spans.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import fresh

#: The base kinds in their order, as Java patterns; a shorter hex run or key would fail anyway.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
PART = r"[A-Za-z0-9+]{20,}"
KINDS = ("assign", "access", "hex", "markov")
#: The codes of "+" to "z", which hold the alphabet of runs.
LOW, SIDE = 43, 80
SPAN = "array<struct<start:int,k:int,stop:int,value:string>>"
THRESHOLD, LETTERS = 0.35, 1.0
#: The words identifiers are made of.
NAMES = "get set user name id list item count total index value key data file path read write load save open close init start stop run test check valid parse format string number date time page size max min sum mean config option default error warning message event handler request response client server session account address status code type model view controller service manager factory builder helper util query table column row field table record update delete insert select order price amount customer product image button label width height color style".split()


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once for each row."""
    return F.element_at(F.transform(F.array(x), f), 1)


def running(x: Column, width: int = 256) -> Column:
    """Running sums of an array of numbers.  Sums within blocks of `width` grow by copying; those of blocks are added to them, so
    that an array of n numbers costs n * width + (n / width)^2 and not n^2."""

    def sums(a: Column) -> Column:
        grown = F.aggregate(a, F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("out")), lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out")))
        return grown["out"]

    def joined(blocks: Column) -> Column:
        before = let(F.transform(blocks, lambda b: F.element_at(b, -1)), lambda ends: F.concat(F.array(F.lit(0)), sums(ends)))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, plus: F.transform(b, lambda v: v + plus)))

    starts = F.sequence(F.lit(1), F.size(x), F.lit(width))
    return F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(F.transform(starts, lambda i: sums(F.slice(x, i, F.lit(width)))), joined))


def located(text: Column, pattern: str, k: int, least: int = 0) -> Column:
    """Array of (start, k, stop, value) of the pattern's matches; least: characters that group 1 must have."""

    def spans(m: Column) -> Column:
        parts = F.zip_with(m["gaps"], F.arrays_zip(m["whole"].alias("whole"), m["inner"].alias("inner")), lambda g, s: F.struct(F.length(g).alias("g"), F.length(s["whole"]).alias("n"), F.length(s["inner"]).alias("i"), s["whole"].alias("value")))
        return let(F.filter(parts, lambda x: x["n"].isNotNull()), placed)

    def placed(parts: Column) -> Column:
        # the gaps and matches before a match, joined, are as long as its place; blocks keep the running sums linear
        sums = let(F.transform(parts, lambda x: x["g"] + x["n"]), lambda a: running(a))
        made = F.zip_with(parts, sums, lambda x, stop: F.struct(x["i"].alias("i"), F.struct((stop - x["n"]).alias("start"), F.lit(k).alias("k"), stop.alias("stop"), x["value"].alias("value")).alias("span")))
        return F.transform(F.filter(made, lambda x: x["i"] >= least), lambda x: x["span"])

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if least else 0)).alias("inner"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(F.array().cast(SPAN))


def default_samples(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(value, random): digests in hexadecimal and base 64, and identifiers in camel, snake and kebab case, some with numbers."""
    rows = spark.range(n)
    sha = F.sha2(F.col("id").cast("string"), 256)
    digests = rows.select(F.when(F.col("id") % 4 == 0, F.substring(sha, 1, 40)).otherwise(F.substring(F.base64(F.unhex(sha)), 1, 40)).alias("value"), F.lit(True).alias("random"))
    names = F.split(F.lit(" ".join(NAMES)), " ")
    parts = F.array(*(F.element_at(names, (F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(NAMES))) + 1).cast("int")) for k in range(4)))
    number = F.when(F.col("id") % 2 == 0, F.concat(F.element_at(F.array(F.lit("_"), F.lit("-"), F.lit("")), (F.col("id") % 3 + 1).cast("int")), F.pmod(F.col("id"), F.lit(2100)).cast("string"))).otherwise("")
    camel = F.array_join(F.transform(parts, lambda w, i: F.when(i == 0, w).otherwise(F.initcap(w))), "")
    named = F.when(F.col("id") % 4 == 0, camel).when(F.col("id") % 4 == 1, F.array_join(parts, "_")).when(F.col("id") % 4 == 2, F.array_join(parts, "-")).otherwise(F.array_join(parts, "/"))
    return digests.unionByName(rows.select(F.concat(named, number).alias("value"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """log2 P(next | before, random) - log2 P(next | before, identifier) for each pair of codes, smoothed by half a count."""
    pairs = samples.select("random", "value", F.explode(F.sequence(F.lit(1), F.length("value") - 1)).alias("i")) if samples.columns else samples
    pairs = pairs.where(F.length("value") > 1).select("random", (F.expr("ascii(substr(value, i, 1))") - LOW).alias("a"), (F.expr("ascii(substr(value, i + 1, 1))") - LOW).alias("b"))
    inside = F.col("a").between(0, SIDE - 1) & F.col("b").between(0, SIDE - 1)
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.where(inside).groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    rows = {(k, a): sum(counts.get((k, a, b), 0) for b in range(SIDE)) for k in (True, False) for a in range(SIDE)}
    logp = lambda k, a, b: math.log2((counts.get((k, a, b), 0) + 0.5) / (rows[k, a] + 0.5 * 64))
    return [logp(True, a, b) - logp(False, a, b) for a in range(SIDE) for b in range(SIDE)]


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of a string of the alphabet."""
    table = F.expr(f"array({','.join(f'{x:.4f}D' for x in model)})")
    codes = F.transform(F.split(value, "(?!^)(?!$)"), lambda c: F.ascii(c) - LOW)

    def mean(c: Column) -> Column:
        step = lambda s, x: F.struct(x.alias("before"), F.when(s["before"] < 0, s["sum"]).otherwise(s["sum"] + F.element_at(table, s["before"] * SIDE + x + 1)).alias("sum"))
        return F.aggregate(c, F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("sum")), step)["sum"] / F.greatest(F.size(c) - 1, F.lit(1))

    return let(codes, mean)


def scan(docs: DataFrame, model: list[float] | None = None, base: str = "_base", added: str = "_added", runs: str = "_runs") -> DataFrame:
    """docs with base and added: arrays of (start, k, stop, value), k the place in KINDS, by start and kind."""
    model = train(default_samples(docs.sparkSession)) if model is None else model
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(located(text, ASSIGN, 0, 6), located(text, ACCESS, 1), located(text, HEX, 2))
    out = docs.withColumn(base, F.array_sort(found)).withColumn(runs, located(text, RUN, 3))

    def secret(x: Column) -> Column:
        free = ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
        digit, mixed = x["value"].rlike("[0-9]"), x["value"].rlike("[a-z][A-Z].*[a-z][A-Z]")
        return x["value"].rlike("[A-Za-z]") & (digit | mixed) & (ratio(x["value"], model) > F.when(digit, THRESHOLD).otherwise(LETTERS)) & free

    def parts(x: Column) -> Column:
        moved = lambda y: F.struct((x["start"] + y["start"]).alias("start"), y["k"].alias("k"), (x["start"] + y["stop"]).alias("stop"), y["value"].alias("value"))
        return F.when(x["value"].rlike("[/_=-]"), F.filter(F.transform(located(x["value"], PART, 3), moved), secret)).otherwise(F.array().cast(SPAN))

    more = F.flatten(F.transform(runs, lambda x: F.when(secret(x), F.array(x)).otherwise(parts(x))))
    return out.withColumn(added, F.when(F.size(runs) > 0, more).otherwise(F.array().cast(SPAN))).drop(runs)


def listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def find(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each row of docs (doc_id, text)."""
    found = scan(docs.select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("_added").cast("long").alias("n_markov"), F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.array_sort(F.concat("_base", "_added"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """docs with every span of its text replaced by mark (n_chars follows); texts without spans and all other columns stay.
    Spans that overlap are replaced by one mark, from the first's start to the furthest end."""
    base, added, runs = fresh(docs, "_base", "_added", "_runs")
    found = scan(docs, model, base, added, runs)
    text = F.col("text")
    span = "array<struct<start:int,stop:int>>"
    begin = F.struct(F.lit(-1).alias("start"), F.lit(0).alias("stop"), F.array().cast(span).alias("out"))

    def step(s: Column, x: Column) -> Column:
        # an open span is closed, and put out, by the first one that starts at its end or later
        apart = (s["start"] >= 0) & (x["start"] >= s["stop"])
        closed = F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
        return F.struct(F.when((s["start"] < 0) | apart, x["start"]).otherwise(s["start"]).alias("start"), F.greatest(s["stop"], x["stop"]).alias("stop"), F.when(apart, F.concat(s["out"], closed)).otherwise(s["out"]).alias("out"))

    def joined(s: Column) -> Column:
        kept = F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
        ends, starts = F.concat(F.array(F.lit(0)), F.transform(kept, lambda x: x["stop"])), F.concat(F.transform(kept, lambda x: x["start"]), F.array(F.length(text)))
        return F.array_join(F.zip_with(ends, starts, lambda a, b: F.substr(text, a + 1, b - a)), mark)

    clean = let(F.aggregate(F.array_sort(F.concat(base, added)), begin, step), joined)
    out = found.withColumn("text", F.when(F.size(base) + F.size(added) > 0, clean).otherwise(text)).drop(base, added)
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*(F.col(f"`{c}`") for c in docs.columns))
