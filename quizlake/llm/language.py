"""Language identification by prediction by partial matching (PPM).

A model holds for each language the counts of byte n-grams of 1 to ORDER + 1 bytes: a tree of contexts of 0 to ORDER bytes with
their successors.  A byte costs -log2 of its probability in the longest context that the language knows; where the context
hasn't seen the byte, an escape (method C: d / (T + d) with T counts of d successors) leads to the next shorter one, and from
the empty one to 1 / 256.  A text's code length is the sum over all of its bytes, contexts reaching back to its first one;
the language of the shortest code is predicted, of equal ones the first by name.  Texts are read in small letters, and what
says nothing about a language (runs of digits, signs and blanks; numbers, keys, addresses: any piece with a digit or @) as one blank.  Statistics are frozen: a text's own bytes
change nothing.  Bytes that longer contexts have refused aren't taken out of the shorter ones, so codes are somewhat long,
for each language alike.

Scoring all languages at once: the n-grams of all languages are one table, closed under leaving off the first or last
byte.  The cost of a byte in language l is B[g, l] + A[c, l], where g is the longest n-gram of the table that ends with the byte,
c the longest context of the table before it, A the escapes from all contexts ending in c, and B the cost in the context that
answers less the escapes below it.  One lookup a byte gives g, and c of the next byte.  Costs are integers (2^-16 bits), so sums
don't depend on blocks or order.

Training reads text and lang of rows outside of the held-out fold, at most MAX_ROWS rows (those with the smallest hash of id
and text) of each of the MAX_LANGS most frequent languages, whole texts; a documented bound.  Rows that repeat both train once.  Of their n-grams a language keeps those
of at least m occurrences, m the smallest count that leaves at most MAX_GRAMS (fewer where the table would grow beyond ENTRIES).

score is the probability of the predicted language if each was as likely before.  Texts that are null or hold no letter, and
all texts if nothing was learnt, are `und` with score 0.  Repeated rows count as often as they occur; a null id counts as the
empty text in the fold; other columns are ignored.  Long texts are scored in blocks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Scratch, id_crc, prepare

ORDER = 4
MAX_ROWS, MAX_LANGS, MAX_GRAMS, ENTRIES = 3000, 128, 80_000, 16_000_000
BITS, UNIT = 65536, 8.0  # parts of a bit; the cost of a byte that no context knows
WINDOW = 1 << 19
U = np.uint64
LETTER = r"\p{L}"
CODE = re.compile(rb"[^\s]*[0-9@][^\s]*")
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def plain(column: pa.Array) -> list[bytes]:
    """Small letters; runs of ASCII other than letters, and pieces between white space that hold a digit or @, read as one blank."""
    return [b" ".join(CODE.sub(b" ", x).translate(LETTERS).split()) for x in pc.utf8_lower(column).cast(pa.binary()).to_pylist()]


def codes(buffer: np.ndarray, place: np.ndarray, order: int = ORDER):
    """For n = 1..order + 1 the n-gram ending at each byte, as n << 40 | bytes; 0 where the text has too few bytes before.
    place: each byte's place in its text."""
    grams, out = np.zeros(len(buffer), U), []
    data = buffer.astype(U)
    for n in range(1, order + 2):
        shifted = np.zeros(len(buffer), U)
        shifted[n - 1 :] = data[: len(data) - n + 1]
        grams = grams | (shifted << U(8 * (n - 1)))
        out.append(np.where(place >= n - 1, grams | (U(n) << U(40)), U(0)))
    return out


def windows(texts: list[bytes], order: int = ORDER, size: int = WINDOW):
    """(buffer, place, text number, first) over blocks of all texts; bytes before first only give context."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(lengths)
    for a in range(0, len(whole), size):
        low = max(0, a - order)
        at = np.arange(low, min(len(whole), a + size))
        number = np.searchsorted(ends, at, side="right")
        yield whole[low : low + len(at)], at - (ends - lengths)[number], number, a - low


def _counted(order: int):
    def run(batches):
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), plain(batch.column("text")), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for buffer, place, _, first in windows(texts, order):
                    every = np.concatenate([c[first:] for c in codes(buffer, place, order)])
                    gram, n = np.unique(every[every > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return run


def tables(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int) -> dict:
    """The model from kept n-grams: rows 1.. of A and B are the n-grams in order, row 0 the empty context."""
    every = np.unique(gram)
    count = np.zeros((len(every) + 1, len(langs)))
    count[np.searchsorted(every, gram) + 1, lang] = n
    size = (every >> U(40)).astype(int)
    low = every & U((1 << 40) - 1)

    def row(size, low):
        """Rows of the n-grams of these sizes and bytes; all of them are there."""
        return np.where(size > 0, np.searchsorted(every, (size.astype(U) << U(40)) | low) + 1, 0)

    masks = np.array([(1 << 8 * k) - 1 for k in range(order + 2)], U)
    shorter = np.concatenate([[0], row(size - 1, low & masks[size - 1])]) if len(every) else np.zeros(1, int)
    before = np.concatenate([[0], row(size - 1, low >> U(8))]) if len(every) else np.zeros(1, int)
    size = np.concatenate([[0], size])
    total, kinds = np.zeros_like(count), np.zeros_like(count)
    np.add.at(total, before[1:], count[1:])
    np.add.at(kinds, before[1:], (count[1:] > 0).astype(float))
    with np.errstate(divide="ignore", invalid="ignore"):
        escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
        own = -np.log2(count / (total + kinds)[before])
    a, b = escape.copy(), np.full_like(count, UNIT)
    for k in range(1, order + 2):
        at = np.flatnonzero(size == k)
        if k <= order:
            a[at] += a[shorter[at]]
        b[at] = np.where(count[at] > 0, own[at] - a[before[at]], b[shorter[at]])
    top = size == order + 1  # as a context it is its last bytes
    a[top] = a[shorter[top]]
    whole = lambda x: np.round(x * BITS).astype(np.int64)
    return {"langs": langs, "order": order, "a": whole(a).astype(np.int32), "b": whole(b).astype(np.int32), **hashed(every)}


FACTOR = U(0x9E3779B97F4A7C15)


def hashed(every: np.ndarray) -> dict:
    """An open hash table of the n-grams: keys and rows; 0 is an empty slot."""
    bits = max(8, int(np.ceil(np.log2(4 * len(every) + 1))))
    keys, rows, todo, step, slots = np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32), np.arange(len(every)), 0, None
    home = (every * FACTOR >> U(64 - bits)).astype(np.int64)
    while len(todo):
        slots = (home[todo] + step) & ((1 << bits) - 1)
        free = keys[slots] == 0
        _, first = np.unique(slots, return_index=True)
        won = np.zeros(len(todo), bool)
        won[first] = True
        won &= free
        keys[slots[won]], rows[slots[won]] = every[todo[won]], todo[won] + 1
        todo, step = todo[~won], step + 1
    return {"bits": bits, "keys": keys, "rows": rows, "steps": step}


def found(model: dict, query: np.ndarray) -> np.ndarray:
    """Rows of n-grams, 0 for those that aren't in the table."""
    bits, keys, rows = model["bits"], model["keys"], model["rows"]
    slot = (query * FACTOR >> U(64 - bits)).astype(np.int64)
    there = keys[slot]
    out = np.where(there == query, rows[slot], 0)
    todo = np.flatnonzero((there != query) & (there != 0))
    for step in range(1, model["steps"]):
        if not len(todo):
            break
        at = (slot[todo] + step) & ((1 << bits) - 1)
        there = keys[at]
        hit = there == query[todo]
        out[todo[hit]] = rows[at[hit]]
        todo = todo[~hit & (there != 0)]
    return out


def lengths(model: dict, texts: list[bytes], size: int = WINDOW) -> np.ndarray:
    """Code lengths (text, language) in parts of a bit."""
    order, a, b = model["order"], model["a"], model["b"]
    out = np.zeros((len(texts), len(model["langs"])), np.int64)
    last = 0  # the row of the byte before the block
    for buffer, place, number, first in windows(texts, order, size):
        row, todo = np.zeros(len(buffer), np.int64), np.arange(first, len(buffer))
        for grams in reversed(codes(buffer, place, order)):
            got = found(model, grams[todo])
            row[todo] = got
            todo = todo[got == 0]
            if not len(todo):
                break
        row, place, number = row[first:], place[first:], number[first:]
        before = np.concatenate([[last], row[:-1]])
        before[place == 0] = 0
        last = row[-1]
        cost = b[row] + a[before]
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        out[number[starts]] += np.add.reduceat(cost.astype(np.int64), starts, axis=0)
    return out


def fit(docs: DataFrame, order: int = ORDER, max_rows: int = MAX_ROWS, max_grams: int = MAX_GRAMS) -> dict:
    """The model from the rows of docs (doc_id, text, lang) outside of the held-out fold."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    known = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string").alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_crc() % 4 != 2))
    known = known.withColumn("_h", F.xxhash64("doc_id", "text")).withColumn("_bucket", F.shiftright("_h", 48))
    # how far into the order of hashes a language has to go is told by its counts in 2^16 ranges of them
    counts = scratch.table(known.select("lang", "_h", "_bucket").distinct().groupBy("lang", "_bucket").agg(F.count("*").alias("n")), "drawn")
    langs = sorted(r.lang for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect())
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.where(F.col("lang").isin(langs)).withColumn("_before", before).where(F.col("_before") < max_rows).groupBy("lang").agg(F.max("_bucket").alias("_last"))
    near = known.join(F.broadcast(last), "lang").where(F.col("_bucket") <= F.col("_last"))  # MAX_LANGS rows are sent
    own = near.select("lang", "_h").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= max_rows)
    pick = scratch.table(own.select("lang", "_h"), "drawn")
    rows = near.join(F.broadcast(pick), ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.first("text").alias("text")).select("lang", "text")  # max_rows a language
    counted = scratch.table(rows.repartition(F.xxhash64("text")).mapInArrow(_counted(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    most = max(256, min(max_grams, ENTRIES // max(1, len(langs)) ** 2))
    sizes: dict[str, list] = {x: [] for x in langs}
    for r in counted.groupBy("lang", F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("k")).collect():
        sizes[r.lang].append((r.n, r.k))
    least = {}
    for lang, own in sizes.items():
        held, least[lang] = 0, 100_001
        for n, k in sorted(own, reverse=True):
            held += k
            if held > most:
                break
            least[lang] = n
    bound = docs.sparkSession.createDataFrame(list(least.items()), "lang string, least long")
    kept = counted.join(F.broadcast(bound), "lang").where(F.col("n") >= F.col("least")).select("lang", "gram", "n").toArrow()  # `most` a language
    number = {x: i for i, x in enumerate(langs)}
    columns = np.array([number[x] for x in kept.column("lang").to_pylist()], int), np.asarray(kept.column("gram")).astype(U), np.asarray(kept.column("n"))
    scratch.drop("drawn", "grams")
    return tables(langs, *columns, order)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    langs = model["langs"]

    def run(batches):
        for batch in batches:
            texts = plain(batch.column("text").fill_null(""))
            bits = lengths(model, texts) / BITS
            best = bits.argmin(1)
            score = 1 / np.exp2(-(bits - bits.min(1)[:, None])).sum(1)
            und = ~np.asarray(batch.column("worded"), bool)
            names = pa.array([None if u else langs[i] for u, i in zip(und, best, strict=True)], pa.string()).fill_null("und")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), names, pa.array(np.where(und, 0.0, score))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(text.rlike(LETTER), F.lit(False)).alias("worded"))
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double") if langs else rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return out.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
