"""Answer keys in text: pairs of number and letter, special states, several sets in one key, the set of a paper.

Everything stays in higher-order functions over one row's arrays, so no key is shuffled.  Digits are ASCII.  A null or empty text
has no answers.  Of several answers to one number the first holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions.text import col

# How pairs are written, the range of numbers, codes, the words before a set's letter.
PAIRS = {
    "verbose": r"(?i)(?:Q(?:uestion)?\.?\s*(?:No\.?)?\s*|Ans(?:wer)?\s+(?:to|for)?\s*Q\.?\s*)(\d{1,3})\s*[-:.)]?\s*(?:Ans(?:wer)?s?\.?\s*[-:.]?\s*)?\(?([A-D1-4])\)?",
    "inline": r"(?i)(?<!\d)(?:Q\.?\s*)?(\d{1,3})\s*[-.):,/]\s*\(?([A-D1-4])\)?",
    "tabular": r"(?i)(?<!\d)(\d{1,3})\s+([A-D1-4X])(?!\S)",
}
GONE = r"(?i)(?<!\d)(\d{1,3})\s*[-.):,/\s]\s*(X)(?!\S)"
EITHER = r"(?i)(?<!\d)(\d{1,3})\s*[-.):,/\s]?\s*([A-D])\s*(?:or\s*|/\s*)?([A-D])(?!\S)"
ROW = r"(?i)(?<!\d)(\d{1,3})\s+([A-D1-4])\s+([A-D1-4])\s+([A-D1-4])\s+([A-D1-4])(?!\S)"
HEADER = r"(?:SET|SERIES|BOOKLET|PAPER)\s*[-:]?\s*([A-D])\b"
PAPER_SET = r"(?i)(?:SET|SERIES|BOOKLET|PAPER|CODE|VERSION)\s*[-:.]?\s*([A-D])\b"
LAST_NUMBER, DEFAULT_COUNT, LEAST_COVERAGE = 300, 150, 0.30
CODES = {"1": "A", "2": "B", "3": "C", "4": "D", "X": "DELETED"}
LABELS = ("A", "B", "C", "D")
ANSWERS = "array<struct<number:int,answer:string>>"


def letter(x) -> Column:
    """A to D, DELETED for X, `B|C` for two different letters, else null."""
    told = {x: x for x in LABELS} | {a + b: f"{a}|{b}" for a in LABELS for b in LABELS if a != b} | CODES
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in told.items() for v in pair)), F.upper(F.trim(col(x))))


def one_each(found: Column, last: bool = False) -> Column:
    """(number, answer) pairs by number, the first or last of each; null answers and numbers out of range count for nothing."""
    placed = F.transform(found, lambda x, i: F.struct(x["number"].alias("number"), (-i if last else i).alias("at"), x["answer"].alias("answer")))
    valid = F.filter(placed, lambda x: x["number"].between(1, LAST_NUMBER) & x["answer"].isNotNull())
    chosen = F.transform(F.array(F.sort_array(valid)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["number"] != x["number"])))[0]
    return F.transform(chosen, lambda x: F.struct(x["number"].alias("number"), x["answer"].alias("answer"))).cast(ANSWERS)


def _pairs(text, pattern: str, *groups: int) -> Column:
    """All matches: the number and the letters of the groups, written together."""
    text = F.coalesce(col(text), F.lit(""))
    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    given = part(groups[0]) if len(groups) == 1 else F.zip_with(part(groups[0]), part(groups[1]), lambda a, b: F.concat(a, b))
    return F.zip_with(part(1), given, lambda n, a: F.struct(n.cast("int").alias("number"), letter(a).alias("answer")))


def by_strategy(text, strategy: str) -> Column:
    return one_each(_pairs(text, PAIRS[strategy], 2))


def special(text) -> Column:
    """Deleted questions, then those with two accepted letters."""
    return one_each(F.concat(_pairs(text, GONE, 2), _pairs(text, EITHER, 2, 3)))


def merged(answers, more) -> Column:
    """answers, and those of `more` for other numbers."""
    return one_each(F.concat(col(answers), col(more)))


def coverage(answers, expected) -> Column:
    """The share of 1..expected that has an answer; without a count up to the largest number."""
    a = col(answers)
    top = F.coalesce(F.array_max(a)["number"], F.lit(DEFAULT_COUNT))
    return F.when(col(expected) > 0, F.size(F.filter(a, lambda x: x["number"] <= col(expected))) / col(expected)).otherwise(F.size(a) / top)


def parsed(text, expected) -> Column:
    """The answers of the strategy that covers most; of equals verbose goes before inline before tabular."""
    tried = F.array(*(by_strategy(text, s) for s in PAIRS))
    scored = F.transform(tried, lambda a, i: F.struct(coverage(a, expected).alias("score"), (-i).alias("order"), a.alias("answers")))
    return F.array_max(scored)["answers"]


def paper_set(pages) -> Column:
    """The letter that the first of the first three pages to name a set gives, or null."""
    found = F.transform(F.slice(col(pages), 1, 3), lambda p: F.upper(F.regexp_extract(F.coalesce(p, F.lit("")), PAPER_SET, 1)))
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with this column, computed once: it comes from a generator, so no filter on it or on what is made of it is pushed below."""
    return df.select("*", F.inline(F.array(F.struct(column.alias(name)))))


def by_set(df: DataFrame, text: str, expected: str) -> DataFrame:
    """df with sets, an array of (label, answers): by headed sections, else by rows of four columns, else one key for all labels.
    A text is read in the next way only if the one before it gave fewer than two sets."""
    t = F.coalesce(F.col(text), F.lit(""))
    few = lambda c: F.size(F.filter(c, lambda a: a.isNotNull())) < 2
    df = _once(df, "_pieces", F.filter(F.split(t, f"(?i)(?={HEADER})"), lambda p: p.rlike(f"(?i)^{HEADER}")))
    sections = F.transform("_pieces", lambda p: F.struct(F.upper(F.regexp_extract(p, f"(?i)^{HEADER}", 1)).alias("label"), parsed(p, expected).alias("answers")))
    df = _once(df, "_sections", F.when(F.size("_pieces") >= 2, sections).otherwise(F.array().cast(f"array<struct<label:string,answers:{ANSWERS}>>")))
    last = lambda k: F.try_element_at(F.filter("_sections", lambda s: (s["label"] == k) & (F.size(s["answers"]) > 0)), F.lit(-1))["answers"]
    df = _once(df, "_headed", F.array(*(last(k) for k in LABELS)))
    rows = F.transform(F.regexp_extract_all(t, F.lit(ROW), F.lit(0)), lambda m: F.split(m, r"\s+"))  # number and four letters
    df = _once(df, "_rows", F.when(few("_headed"), rows))
    column = lambda i: F.transform("_rows", lambda r: F.struct(r[0].cast("int").alias("number"), letter(r[i]).alias("answer")))
    columns = F.array(*(one_each(column(i + 1), last=True) for i in range(len(LABELS))))
    covering = F.transform(columns, lambda a: F.when(coverage(a, expected) > LEAST_COVERAGE, a))
    df = _once(df, "_sets", F.when(few("_headed"), F.zip_with(covering, "_headed", lambda x, y: F.coalesce(x, y))).otherwise(F.col("_headed")))
    df = _once(df, "_told", F.when(few("_sets"), F.array_repeat(parsed(t, expected), len(LABELS))).otherwise(F.col("_sets")))
    named = F.zip_with(F.array(*map(F.lit, LABELS)), "_told", lambda k, a: F.struct(k.alias("label"), a.alias("answers")))
    return _once(df, "sets", F.filter(named, lambda s: s["answers"].isNotNull())).drop("_pieces", "_sections", "_headed", "_rows", "_sets", "_told")
