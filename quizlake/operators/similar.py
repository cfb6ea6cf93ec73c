"""Trigram similarity (D13): an inverted index of the trigrams of texts, threshold joins and searches over it.

Trigrams are those of small-letter words of letters and digits, each with two blanks before and one behind it; the similarity of
two texts is the share of their trigrams that both have.  Sets of similarity t share a trigram among the first
n - ceil(t * n) + 1 of each, rarest first, and differ in size by a factor of t at most.  The index holds only those first
trigrams; a pair is compared once, at the first one that both have there, so none below the bound comes out and none is lost.
Of two sets in one table the smaller shares at least 2t / (1 + t) of its own, so fewer of its trigrams are in the index.

Equal texts are one entry with a number of rows; the pairs are of different texts, so copies are never paired with each other.
Null texts and those without letters or digits have no trigrams and are like nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

# Fixed value: the marks of a set are so many words of 64 bits.
WORDS = 4


def trigrams(x) -> Column:
    """The distinct trigrams of a text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def entries(rows: DataFrame, text: str) -> DataFrame:
    """text, grams, copies: a row for each different text with trigrams.  A trigram is the number that its three characters make."""
    out = rows.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    sign = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("long")
    number = lambda g: F.shiftleft(sign(g, 1), 42) + F.shiftleft(sign(g, 2), 21) + sign(g, 3)
    return out.select("text", F.transform(trigrams("text"), number).alias("grams"), "copies").where(F.size("grams") > 0)


def _marks(grams) -> list[Column]:
    """A bit for each trigram, at a place that its hash gives, in WORDS columns of 64 bits."""
    places = F.transform(grams, lambda g: F.pmod(F.hash(g), F.lit(64 * WORDS)))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))
    word = lambda k: F.aggregate(F.filter(places, lambda p: F.floor(p / 64) == k), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(bit(p)))
    return [word(k).alias(f"mark_{k}") for k in range(WORDS)]


def index(texts: DataFrame, share: float, frequencies: DataFrame) -> DataFrame:
    """gram, place, text, grams, n, mark_0 ...: a row for each of the first trigrams of each text, rarest first by frequencies (gram,
    freq), with its place from 0; grams are all in this order.  A trigram without a frequency counts as one that is nowhere."""
    spread = texts.select("text", F.explode("grams").alias("gram")).join(frequencies, "gram", "left")
    ordered = spread.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "gram"))).alias("by"))
    ordered = ordered.select("text", F.transform("by", lambda x: x["gram"]).alias("grams"), F.size("by").alias("n"))
    return ordered.select("*", *_marks("grams")).select("*", F.posexplode(F.slice("grams", 1, _first(share * F.col("n")))).alias("place", "gram"))


def _first(least: Column) -> Column:
    """How many of n trigrams, the rarest, hold one of any `least` of them."""
    return (F.col("n") - F.ceil(least - 1e-7) + 1).cast("int")


def _joined(a: DataFrame, b: DataFrame, share: float, apart: Column) -> DataFrame:
    """What both have is bounded by what stands behind the first trigram in common, and by the marks that one has and the other has
    not, before it is counted."""
    a, b = a.alias("a"), b.alias("b")
    sized = (F.col("a.n") >= share * F.col("b.n") - 1e-9) & (F.col("b.n") >= share * F.col("a.n") - 1e-9)
    enough = lambda both: (1 + share) * both >= share * (F.col("a.n") + F.col("b.n")) - 1e-6
    behind = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    alone = lambda x, y: sum(F.bit_count(F.col(f"{x}.mark_{k}").bitwiseAND(F.bitwise_not(f"{y}.mark_{k}"))) for k in range(WORDS))
    bounded = enough(behind) & enough(F.col("a.n") - alone("a", "b")) & enough(F.col("b.n") - alone("b", "a"))
    # counted by a generator, since a filter on what both have would else go into the join, ahead of the bounds
    counted = F.array(F.struct(F.array_intersect(F.col("a.grams"), F.col("b.grams")).alias("common")))
    # dealt by trigrams even if b is small: a trigram's pairs are many more than its rows, so the work is not to follow a's few partitions
    pairs = a.join(b.hint("merge"), (F.col("a.gram") == F.col("b.gram")) & sized & apart & bounded)
    pairs = pairs.select(F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"), F.col("a.gram").alias("gram"), (F.col("a.n") + F.col("b.n")).alias("sum"), F.inline(counted))
    pairs = pairs.where(F.get("common", F.lit(0)) == F.col("gram")).withColumn("both", F.size("common"))
    return pairs.where(F.col("both") >= share * (F.col("sum") - F.col("both")) - 1e-9).select("text_a", "text_b", (F.col("both") / (F.col("sum") - F.col("both"))).alias("similarity"))


def frequencies(*texts: DataFrame) -> DataFrame:
    every = texts[0]
    for t in texts[1:]:
        every = every.unionByName(t)
    return every.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("freq"))


def similar_pairs(rows: DataFrame, text: str, share: float) -> DataFrame:
    """text_a, text_b, similarity of the pairs of different texts of at least that similarity, 0 < share <= 1, text_a before text_b."""
    if not 0 < share <= 1 or math.isnan(share):
        raise ValueError("share must lie above 0 and be at most 1")
    texts = entries(rows, text)
    posted = index(texts, share, frequencies(texts))
    # b is the smaller set, or the first text of equal ones: it has the larger part in common, so fewer of its trigrams are looked up
    smaller = posted.where(F.col("place") < _first(2 * share / (1 + share) * F.col("n")))
    found = _joined(posted, smaller, share, (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.text") > F.col("b.text"))))
    return found.select(F.least("text_a", "text_b").alias("text_a"), F.greatest("text_a", "text_b").alias("text_b"), "similarity")


def search(queries: DataFrame, query: str, rows: DataFrame, text: str, share: float) -> DataFrame:
    """text_a (a query), text_b, similarity: what of rows is at least that similar to each different query, itself included."""
    if not 0 < share <= 1 or math.isnan(share):
        raise ValueError("share must lie above 0 and be at most 1")
    asked, texts = entries(queries, query), entries(rows, text)
    often = frequencies(texts)  # of the rows alone: a trigram that none of them has leads nowhere and goes first
    return _joined(index(asked, share, often), index(texts, share, often), share, F.lit(True))
