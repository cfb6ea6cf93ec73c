"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs to Latin letters, digits and signs used for letters to these letters, and drops
zero-width characters.  The lexicon holds whole words and beginnings of longer words (4 to 8 letters).  A term enters if,
within a language, it stands in more toxic training rows than chance explains: the Chernoff bound of its document counts
must beat the number of terms tried, and its odds those of the language by 8.  Its weight is -ln of the upper bound of
its rate in clean words, the highest of any language.  Phrases (a term with its neighbour) that occur mainly in clean
rows are exceptions: hits inside them don't count.

A text's evidence is the sum over hits of max(0, weight - ln(words)): how unlikely a clean text of that length is to hold
them.  So one hit of a term that clean texts never have counts in long texts too, and one that prose makes by chance
counts little there.  A logistic curve makes the evidence a score; its slope is never negative.  It is fitted on rows that
did not choose the lexicon (two halves, each scored by the other's terms), with each toxic row also as if it had but the median of its hits,
by counts of evidence in steps of STEP, which Spark sums.

Training uses at most MAX_ROWS labelled rows (those with the smallest hash of the id), a documented bound; of texts that
repeat such an id one is taken.  Copies say nothing new, but would make every word of a copied text look telling: of rows
that share one of DRAWS MinHash values of their word 3-grams one stays.  Terms and exceptions are bounded by these rows.
Null and empty texts score like texts without hits.  Where too little is labelled for a curve (fewer than LEAST rows of a
kind) it keeps FIXED; without terms every text has the score of the curve at 0.  Words known beforehand can be given as `seeds` (none by
default); they stand beside what was learnt, weighed by how rare they are in the clean rows.
Labels that occur more than once for an id count as toxic if any of them is.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import U64, Scratch, grams, hasher, id_crc, prepare, space_words

MAX_ROWS, MIN_DOCS, ODDS, THRESHOLD = 20_000, 3, 8, 0.3
#: Steps and end of the evidence's histogram; rows of a kind that a curve needs, and the curve without them.
STEP, MOST, LEAST, FIXED = 0.25, 40.0, 10, (-4.0, 1.2)
DRAWS = 6
#: How much rarer a term that clean rows hold must be than it is: what prose makes by chance must not mark it.
CHANCE = 4.0
#: Clean words without any of the seeds that are taken as read.
SEED_WORDS = 1_000_000
#: What each letter may be disguised as.
LOOKALIKE = {
    "a": "4аα", "b": "8ь", "c": "сϲ", "d": "ԁ", "e": "3еε", "g": "ɡ", "h": "һ", "i": "1іι", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "п", "o": "0оο", "p": "рρ", "q": "ԛ", "s": "5ѕ",
    "t": "7тτ", "u": "υ", "v": "ν", "w": "ѡω", "x": "хχ", "y": "уγ", 
}
FOLD = {ord(c): letter for letter, others in LOOKALIKE.items() for c in others} | {ord(c): None for c in "​‌‍⁠﻿­"} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
WORD = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7, 8)


#: Signs that stand for a letter only between letters.
SIGNS = {"@": "a", "$": "s", "!": "i"}
SIGN = re.compile(r"(?<=[^\W\d_])[@$!](?=[^\W\d_])")


def fold(text: str | None) -> str:
    text = (text or "").lower().translate(FOLD)
    return SIGN.sub(lambda m: SIGNS[m[0]], text) if any(c in text for c in SIGNS) else text


def terms(text: str) -> Counter:
    """How often each word of a folded text occurs, and with a star, each beginning of longer words."""
    words = Counter(WORD.findall(text))
    for word, n in list(words.items()):
        for k in PREFIXES:
            if len(word) <= k:
                break
            words[f"{word[:k]}*"] += n
    return words


def automaton(lexicon: dict[str, float], exceptions: set[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        text = term.rstrip("*")
        old = out.get(text, (0.0, 0.0, len(text), False))
        out.add_word(text, (old[0], weight, len(text), old[3]) if term.endswith("*") else (weight, old[1], len(text), old[3]))
    for phrase in exceptions:
        old = out.get(phrase, (0.0, 0.0, len(phrase), False))
        out.add_word(phrase, (old[0], old[1], len(phrase), True))
    if len(out):
        out.make_automaton()
    return out


def hits(machine, text: str) -> list[tuple[int, int, float]]:
    """Start, end and weight of the terms in a folded text: the heaviest for each word, none inside an exception."""
    if not len(machine):
        return []
    found: dict[int, tuple[int, float]] = {}
    excused = []
    for last, (word, start_only, n, exception) in machine.iter(text):
        begin, end = last + 1 - n, last + 1
        if begin and text[begin - 1].isalnum():
            continue
        whole = end == len(text) or not text[end].isalnum()
        if exception and whole:
            excused.append((begin, end))
        weight = word if whole else start_only
        if weight > found.get(begin, (0, 0.0))[1]:
            found[begin] = (end, weight)
    return [(b, e, w) for b, (e, w) in sorted(found.items()) if not any(x <= b and e <= y for x, y in excused)]


def evidence(machine, text: str) -> list[float]:
    """What each hit in a folded text says beyond chance, given the text's length."""
    got = hits(machine, text)
    length = math.log(1 + len(text.split())) if got else 0.0
    return [max(0.0, w - length) for _, _, w in got]


def _counts(rows):
    for batch in rows:
        found: dict[tuple, list[int]] = {}
        for half, lang, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("half", "lang", "toxic", "text")), strict=True):
            for term, n in terms(fold(text)).items():
                own = found.setdefault((half, lang, term), [0, 0, 0])
                own[0 if toxic else 1] += 1
                own[2] += 0 if toxic else n
        names, kinds = ("half", "lang", "term", "t", "c", "o"), [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*((*k, *v) for k, v in found.items()), strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _sketches(rows):
    """_id and the DRAWS least hashes of the word 3-grams under as many orders."""
    hashed, rng = hasher(), np.random.default_rng(20250711)
    a, b = rng.integers(1, 2**63, DRAWS, np.uint64) | U64(1), rng.integers(0, 2**63, DRAWS, np.uint64)
    for batch in rows:
        out = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            h = hashed(space_words(text))
            g = grams(h, min(3, len(h))) if len(h) else np.zeros(1, U64)
            out.append([int(x) for x in (((g[:, None] ^ (g[:, None] >> U64(31))) * a + b) >> U64(1)).min(axis=0)])
        yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([x[i] for x in out], pa.int64()) for i in range(DRAWS))], ["_id", *(f"m{i}" for i in range(DRAWS))])


def _thinned(rows: DataFrame) -> DataFrame:
    """rows without near copies of one another."""
    kind, names = rows.schema["_id"].dataType.simpleString(), [f"m{i}" for i in range(DRAWS)]
    left = rows.select("_id", "text").mapInArrow(_sketches, ", ".join([f"_id {kind}", *(f"{m} long" for m in names)]))
    for m in names:
        left = left.groupBy(m).agg(F.min(F.struct("_id", *(x for x in names if x != m))).alias("x")).select("x.*", m)
    return rows.join(F.broadcast(left.select("_id")), "_id", "left_semi")


def _sizes(rows):
    for batch in rows:
        out = [batch.column(c) for c in ("half", "lang", "toxic")]
        yield pa.RecordBatch.from_arrays([*out, pa.array([len(WORD.findall(fold(t))) for t in batch.column("text").to_pylist()], pa.int64())], ["half", "lang", "toxic", "words"])


def _phrases(lexicon):
    def run(rows):
        machine = automaton(lexicon, set())
        for batch in rows:
            toxic, clean = Counter(), Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                text, own = fold(text), set()
                for b, e, _ in hits(machine, text):
                    around = [m for m in WORD.finditer(text, max(0, b - 40), e + 40)]
                    for x, y in zip(around, around[1:], strict=False):
                        if x.start() <= b < x.end() or y.start() <= b < y.end():
                            own.add(text[x.start() : y.end()])
                (toxic if label else clean).update(own)
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "t": pa.array([toxic[k] for k in keys], pa.int64()), "c": pa.array([clean[k] for k in keys], pa.int64())})

    return run


def _evident(halves: list[dict[str, float]], exceptions: set[str]):
    """bin, toxic, weight of the rows: each row by the lexicon that its half did not choose."""

    def run(rows):
        machines = [automaton(x, exceptions) for x in halves]
        for batch in rows:
            out = []
            for half, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("half", "toxic", "text")), strict=True):
                found = sorted(evidence(machines[half], fold(text)))
                if toxic and found:
                    out += [(sum(found), 1, 0.5), (found[len(found) // 2], 1, 0.5)]
                else:
                    out.append((sum(found), int(toxic), 1.0))
            yield pa.RecordBatch.from_arrays([pa.array([int(min(x, MOST) / STEP) for x, _, _ in out], pa.int64()), pa.array([y for _, y, _ in out], pa.int64()), pa.array([w for _, _, w in out], pa.float64())], ["bin", "toxic", "weight"])

    return run


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Intercept and slope of a logistic regression with a small ridge, by Newton's method."""
    if min(weight[y == 1].sum(), weight[y == 0].sum()) < LEAST:
        return list(FIXED)
    x, w, ridge = np.column_stack([np.ones(len(x)), x]), np.array([-3.0, 0.5]), np.diag([1e-2, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w = w + np.clip(step, -1, 1)
    return [float(w[0]), max(0.0, float(w[1]))]


def _chosen(counted: DataFrame, sizes: DataFrame) -> dict[str, float]:
    """Terms and weights from counts (lang, term, t, c, o) and the languages' sizes (lang, nt, nc, words)."""
    rows = counted.where(F.col("t") >= MIN_DOCS).join(F.broadcast(sizes.where("nt > 0 AND nc > 0")), "lang")
    # every term of so many rows could have been chosen, whatever their labels are
    tried = counted.where(F.col("t") + F.col("c") >= MIN_DOCS).groupBy("lang").agg(F.count("*").alias("tried"))
    p, r = F.col("t") / (F.col("t") + F.col("c")), F.col("nt") / (F.col("nt") + F.col("nc"))
    surprise = F.col("t") * F.log(p / r) + F.when(F.col("c") > 0, F.col("c") * F.log((1 - p) / (1 - r))).otherwise(0.0)
    clear = (surprise >= F.log("tried") + 3) & (F.col("t") * F.col("nc") >= ODDS * F.col("c") * F.col("nt")) & (p > r)
    rate = F.when(F.col("o") > 0, CHANCE).otherwise(1.0) * (F.col("o") + 2 * F.sqrt("o") + 3) / F.col("words")
    told = rows.join(F.broadcast(tried), "lang").where(clear).groupBy("term").agg(F.max(rate).alias("rate"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    other = counted.join(F.broadcast(sizes.where("words > 0")), "lang").join(F.broadcast(told.select("term")), "term").groupBy("term").agg(F.max(F.col("o") / F.col("words")).alias("other"))
    found = {r["term"]: (-math.log(max(r["rate"], r["other"])), r["t"], r["c"]) for r in told.join(other, "term", "left").na.fill(0.0).collect()}
    # a beginning goes where one longer term stands for nearly all of its rows, a longer term where a beginning says as much
    longer: dict[str, int] = {}
    for t, (_, n, _) in found.items():
        for k in (k for k in PREFIXES if k < len(t.rstrip("*"))):
            longer[f"{t[:k]}*"] = max(n, longer.get(f"{t[:k]}*", 0))
    found = {t: x for t, x in found.items() if not (t.endswith("*") and longer.get(t, 0) >= 0.9 * x[1])}
    need = math.log(max(1, len(found))) + 3

    def says_more(t: str) -> bool:
        """Whether a term is more toxic than each beginning of it that is there, beyond chance among so many."""
        _, n, clean = found[t]
        for k in (k for k in PREFIXES if k < len(t.rstrip("*"))):
            if (start := found.get(f"{t[:k]}*")) is not None:
                p, r = n / (n + clean), min(start[1] / (start[1] + start[2]), 1 - 1e-9)
                if p <= r or n * math.log(p / r) + (clean * math.log((1 - p) / (1 - r)) if clean else 0.0) < need:
                    return False
        return True

    return {t: found[t][0] for t in sorted(found) if says_more(t)}


def _seeds(counted: DataFrame, words: int, seeds: tuple[str, ...]) -> dict[str, float]:
    if not seeds:
        return {}
    own = {r["term"]: r["o"] for r in counted.where(F.col("term").isin(*seeds)).groupBy("term").agg(F.sum("o").alias("o")).collect()}
    return {t: -math.log((own.get(t, 0) + 2 * math.sqrt(own.get(t, 0)) + 3) / (words + SEED_WORDS)) for t in seeds}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seeds: tuple[str, ...] = ()) -> dict:
    """Lexicon, exceptions and curve from labelled rows outside the held-out fold."""
    prepare(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(id_crc("_id") % 4 != 2).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))
    rows = _thinned(scratch.table(rows.select("_id", "toxic", "x.*"), "known"))
    rows = scratch.table(rows.select((F.xxhash64("_id", F.lit(7)).bitwiseAND(1)).cast("int").alias("half"), "lang", "toxic", "text"), "rows")
    sizes = rows.mapInArrow(_sizes, "half int, lang string, toxic int, words long").groupBy("half", "lang").agg(F.count_if(F.col("toxic") == 1).alias("nt"), F.count_if(F.col("toxic") == 0).alias("nc"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("words"))), F.lit(0)).alias("words"))
    sizes = scratch.table(sizes, "sizes")
    counted = scratch.table(rows.mapInArrow(_counts, "half int, lang string, term string, t long, c long, o long").groupBy("half", "lang", "term").agg(*(F.sum(c).alias(c) for c in "tco")), "counted")
    sums = lambda df, key, names: df.groupBy(key).agg(*(F.sum(c).alias(c) for c in names))
    words = sizes.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    known_words = _seeds(counted, words, seeds)
    whole = sums(counted, ["lang", "term"], "tco"), sums(sizes, ["lang"], ("nt", "nc", "words"))
    lexicon = known_words | _chosen(*whole)
    # rows of half 0 are judged by what half 1 chose, and the other way round
    halves = [known_words | _chosen(counted.where(F.col("half") == h), sizes.where(F.col("half") == h)) for h in (1, 0)]
    told = rows.mapInArrow(_phrases(lexicon), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    exceptions = {r["term"] for r in told.where((F.col("c") >= 3) & (F.col("c") >= 4 * F.col("t"))).collect()}
    bins = rows.mapInArrow(_evident(halves, exceptions), "bin long, toxic long, weight double").groupBy("bin", "toxic").agg(F.sum("weight").alias("weight")).collect()
    x = np.array([((r["bin"] + 0.5) * STEP if r["bin"] else 0.0, r["toxic"], r["weight"]) for r in bins], float).reshape(-1, 3)
    scratch.drop("known", "rows", "sizes", "counted")
    return {"lexicon": lexicon, "exceptions": exceptions, "curve": curve(x[:, 0], x[:, 1], x[:, 2])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score and n_hits for each row of docs (doc_id, text)."""
    prepare(docs.sparkSession)

    def run(batches):
        machine, w = automaton(model["lexicon"], model["exceptions"]), model["curve"]
        for batch in batches:
            found = [evidence(machine, fold(t)) for t in batch.column("text").to_pylist()]
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * min(sum(x), MOST))))) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array([len(x) for x in found], pa.int64())], ["doc_id", "score", "n_hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits.  corpus: where the labelled texts are, docs itself if not given."""
    out = score(docs, fit(docs if corpus is None else corpus, labels))
    return out.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones; the columns stay."""
    bad = toxicity(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
