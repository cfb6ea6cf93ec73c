"""Quality rules [native]: robust multivariate outliers by the minimum covariance determinant.

Each text becomes four numbers that differ among good texts: mean word length, marks and symbols a word, capitals a letter, on
logarithmic scales with a count added, and how its distinct words grow with its words (log distinct / log words).  Repeated
lines and words lower the last one, symbols raise the second.  Few words fail the base rule; many are no fault.

Per language and source a location and covariance are estimated from the h = 75 % of texts that give the covariance the least
determinant.  Concentration steps go on from three starts at once, the classical moments, medians with absolute deviations,
and the moments of spatial signs, since a start that outliers have drawn to them keeps them; each takes the half with the smallest
distances, then h at every step, until no start's determinant falls below its least so far by more than a share of TOLERANCE.  The
pool keeps the model of the least determinant.  A step is one pass over the rows: the three distances stand side by side, and
counts and moments are summed by bin of distance, so that the h-subset and its model come out of a table whose size depends on
pools and bins alone; it doesn't depend on the order of rows.

Distances are Mahalanobis distances by that covariance, scaled by the consistency factor of h, which makes it the covariance
of normal vectors.  A text is rejected beyond FARTHEST standard deviations.  That lies further out than quantiles of normal
vectors do, because these numbers have longer tails, and a clean text lost costs more than a poor one kept.
Groups of fewer than MIN_GROUP texts are pooled by language, and then all together; a pool below MIN_GROUP rejects
nothing.  The diagonal of the factor is FLOORS at least, below what prose has in any pool, so that only pools all but without variance
reach them.

Models have a row for each pool; they are broadcast while they have at most BROADCAST rows, counted first.
Null, empty and wordless texts fail the base rule.  Null languages and sources are groups of their own.
Repeated rows count and are judged as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch

SHARE, TOLERANCE, MIN_GROUP, FARTHEST, BROADCAST = 0.75, 1e-3, 60, 12.0, 20_000
NAMES = ("x_length", "x_marks", "x_capitals", "x_distinct")
#: Least standard deviations of each number, given the ones before it.
FLOORS = (0.02, 0.08, 0.08, 0.003)
STARTS = ("classical", "median", "sign")
MARKS, CAPITALS = ".,;:!?\"'()[]{}#*$%&|<>-_/\\+=~^@`", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"
BINS = 24  # of an octave of squared distance


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution of an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for j in range(1, k // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < share else (lo, mid)
    return (lo + hi) / 2


#: The covariance of the central h of normal vectors is theirs divided by this.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, len(NAMES)), len(NAMES) + 2)
CUTOFF = FARTHEST**2


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it is small, by count."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once for each row."""
    return F.element_at(F.transform(F.array(x), f), 1)


def repeat_words(words: Column) -> Column:
    """Words inside of 3-word windows that the list holds at least twice."""

    def covered(s: Column) -> Column:
        # s: windows as (hash, place), sorted
        twin = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
        places = F.sort_array(F.transform(twin, lambda x: x["i"]))
        step = lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"))
        return F.aggregate(places, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), step)["n"]

    def windows(h: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))
        unique = lambda m: F.size(F.array_distinct(F.transform(m, lambda x: x["h"]))) == F.size(m)
        return let(made, lambda m: F.when(unique(m), F.lit(0)).otherwise(let(F.sort_array(m), covered)))

    return F.when(F.size(words) >= 3, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words and the four base statistics, with the distinct words, marks and capitals."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))).cast("long").alias("n_distinct"))

    by_line = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    of = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")
    out = docs.select("doc_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in ("lang", "source")), let(words, counted).alias("w"), by_line.alias("n_dup_lines"), of("#*$%&|<>").alias("n_symbols"), of(MARKS).alias("n_marks"), of(CAPITALS).alias("n_capitals"))
    return out.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.n_distinct", "n_marks", "n_capitals")


def transformed(stats: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    numbers = {"x_length": F.log2((chars + 1) / (n + 1)), "x_marks": F.log2((F.col("n_marks") + 1) / (n + 1)), "x_capitals": F.log2((F.col("n_capitals") + 1) / (chars + 1)), "x_distinct": F.log2(F.col("n_distinct") + 1) / F.log2(n + 2)}
    return stats.withColumns(numbers | {"base_failed": failed})


def pooled(rows: DataFrame) -> DataFrame:
    """rows with pool: language and source, or the language alone, or neither, whichever has MIN_GROUP texts."""
    counts = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    few = F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)
    sized = counts.withColumn("by_lang", F.sum(few).over(Window.partitionBy("lang")))
    pool = F.when(F.col("n") >= MIN_GROUP, F.concat_ws("\0", F.lit("s"), "lang", "source")).when(F.col("by_lang") >= MIN_GROUP, F.concat_ws("\0", F.lit("l"), "lang")).otherwise("*")
    named = sized.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), pool.alias("pool"))
    return rows.join(small(named), (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")), "left").drop("_lang", "_source")


P = range(len(NAMES))
LOWER = [(i, j) for i in P for j in range(i + 1)]
PARTS = ("n_in", *(f"m{i}" for i in P), *(f"l{i}{j}" for i, j in LOWER), "logdet")
LONE = 2.0**-20  # added to squared distances, so that 0 has a bin


def factored(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums with n_in, means m0.. and covariances c00.. to models: the Cholesky factor, its diagonal FLOORS at least, and logdet."""
    out = sums
    for i, j in LOWER:
        rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum((2 * F.log(F.col(f"l{i}{i}")) for i in P), F.lit(0.0))).select(*keys, *PARTS)


def moments(rows: DataFrame, *keys: str) -> DataFrame:
    """The model of all rows of each key."""
    sums = [F.avg(NAMES[i]).alias(f"m{i}") for i in P] + [F.covar_pop(NAMES[i], NAMES[j]).alias(f"c{i}{j}") for i, j in LOWER]
    return factored(rows.groupBy(*keys).agg(*sums, F.count("*").alias("n_in")), *keys)


def medians(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """pool, m0.., s0..: medians and scaled absolute deviations."""
    mid = small(scratch.table(rows.groupBy("pool").agg(*(F.percentile_approx(NAMES[i], 0.5).alias(f"m{i}") for i in P)), "medians"))
    spread = [(1.4826 * F.percentile_approx(F.abs(F.col(NAMES[i]) - F.col(f"m{i}")), 0.5)).alias(f"s{i}") for i in P]
    return scratch.table(rows.join(mid, "pool").groupBy("pool", *(f"m{i}" for i in P)).agg(*spread), "medians")


def starts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """pool, start, model: one for each of STARTS."""
    told = medians(rows, scratch)
    classical = moments(rows, "pool").withColumn("start", F.lit(0))
    flat = factored(told.select("pool", F.lit(0).cast("long").alias("n_in"), *(f"m{i}" for i in P), *((F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in LOWER)), "pool").withColumn("start", F.lit(1))
    # spatial signs: vectors of length 1 from the median, in units of the deviations
    scaled = rows.join(small(told), "pool")
    unit = lambda i: F.greatest(F.col(f"s{i}"), F.lit(FLOORS[i]))
    scaled = scaled.withColumns({f"_y{i}": (F.col(NAMES[i]) - F.col(f"m{i}")) / unit(i) for i in P})
    scaled = scaled.withColumn("_r", F.sqrt(sum((F.col(f"_y{i}") ** 2 for i in P), F.lit(1e-12))))
    signs = moments(scaled.select("pool", *((F.col(f"m{i}") + F.col(f"_y{i}") / F.col("_r") * unit(i)).alias(NAMES[i]) for i in P)), "pool").withColumn("start", F.lit(2))
    return classical.unionByName(flat).unionByName(signs)


def distance(model: Column) -> Column:
    """The squared Mahalanobis distance of a row by a model, a struct of PARTS."""
    z: list[Column] = []
    for i, name in enumerate(NAMES):
        z.append((F.col(name) - model[f"m{i}"] - sum((z[k] * model[f"l{i}{k}"] for k in range(i)), F.lit(0.0))) / model[f"l{i}{i}"])
    return sum((x * x for x in z), F.lit(0.0))


def side_by_side(models: DataFrame) -> DataFrame:
    """pool, and for each start its model in a column k0.. of its own."""
    of = lambda k: F.max(F.when(F.col("start") == k, F.struct(*PARTS))).alias(f"k{k}")
    return models.groupBy("pool").agg(*(of(k) for k in range(len(STARTS))))


def concentrated(rows: DataFrame, models: DataFrame, share: float, few: bool) -> DataFrame:
    """The models after a step: of the share of the rows with the smallest distances, rounded up to a whole bin.  One pass: rows are
    summed by bin, relative to the start's own mean, then bins up to the one that the share reaches."""
    beside = side_by_side(models)
    both = rows.join(F.broadcast(beside) if few else beside, "pool")
    far = both.select("pool", *NAMES, F.posexplode(F.array(*(F.struct(F.floor(F.log2(distance(F.col(f"k{k}")) + LONE) * BINS).alias("bin"), *(F.col(f"k{k}")[f"m{i}"].alias(f"o{i}") for i in P)) for k in range(len(STARTS))))).alias("start", "r"))
    off = [F.col(NAMES[i]) - F.col(f"r.o{i}") for i in P]
    sums = [F.sum(off[i]).alias(f"a{i}") for i in P] + [F.sum(off[i] * off[j]).alias(f"b{i}{j}") for i, j in LOWER]
    bins = far.groupBy("pool", "start", F.col("r.bin").alias("bin")).agg(F.count("*").alias("n"), *sums, *(F.first(f"r.o{i}").alias(f"o{i}") for i in P))
    key = Window.partitionBy("pool", "start")
    near = bins.withColumns({"_before": F.coalesce(F.sum("n").over(key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("n").over(key)}).where(F.col("_before") < share * F.col("_all"))
    own = near.groupBy("pool", "start").agg(F.sum("n").alias("n_in"), *(F.sum(c).alias(c) for c in [*(f"a{i}" for i in P), *(f"b{i}{j}" for i, j in LOWER)]), *(F.first(f"o{i}").alias(f"o{i}") for i in P))
    own = own.select("pool", "start", "n_in", *((F.col(f"o{i}") + F.col(f"a{i}") / F.col("n_in")).alias(f"m{i}") for i in P), *((F.col(f"b{i}{j}") / F.col("n_in") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("n_in") ** 2).alias(f"c{i}{j}") for i, j in LOWER))
    return factored(own, "pool", "start")


def model_of(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """pool and the model of least determinant that any start has come to, of h rows at least."""
    model = scratch.table(starts(rows, scratch), "model")
    few = model.count() <= BROADCAST
    model = scratch.table(concentrated(rows, model, 0.5, few), "model")
    seen = model.limit(0)
    while True:
        model = scratch.table(concentrated(rows, model, SHARE, few), "model")
        was = seen.groupBy("pool", "start").agg(F.min("logdet").alias("_was"))  # a row for each pool and start
        falls = model.join(was, ["pool", "start"], "left").where("_was IS NULL OR _was - logdet > %g" % TOLERANCE)
        ended = falls.isEmpty()
        seen = seen.unionByName(model)
        if ended:
            break
    first = F.row_number().over(Window.partitionBy("pool").orderBy("logdet", "start"))
    return scratch.table(seen.withColumn("_n", first).where("_n = 1").select("pool", *PARTS), "best")


def distances(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, and n_in, the size of the subset; null without a model."""
    out = rows.join(model.select("pool", F.struct(*PARTS).alias("_model")), "pool", "left")
    return out.withColumns({"d2": distance(F.col("_model")), "n_in": F.col("_model.n_in")}).drop("_model")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, distance and kept for each row of docs (doc_id, text, lang, source)."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.table(statistics(docs), "stats")
    rows = scratch.table(pooled(transformed(stats)), "rows")
    model = model_of(rows.where("NOT base_failed").select("pool", *NAMES), scratch)
    scratch.drop("medians", "model")
    out = distances(rows, small(model)).withColumn("d2", F.col("d2") / CONSISTENCY)
    odd = (F.col("d2") > CUTOFF) & (F.col("n_in") >= SHARE * MIN_GROUP)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d2").alias("distance"), (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"))
