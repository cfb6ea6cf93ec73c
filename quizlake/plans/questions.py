"""Queries on question papers: papers are written from the words of whole documents and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as P
from ..operators import quality as Q
from .queries import query, t

WORDS, EACH, PER_PAPER = 12, 4, 50
TAKE = WORDS + EACH


def _chunks(spark, sf, size: int):
    """doc_id, n (from 0), w: each run of so many ASCII words of every document."""
    d = t(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    n = F.floor(F.size("w") / size).cast("int")
    return d.where(F.size("w") >= size).select("doc_id", "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("n")).select("doc_id", "n", F.slice("w", F.col("n") * size + 1, size).alias("w"))


def _chunks_sql(size: int) -> str:
    return f"d AS (SELECT doc_id, regexp_extract_all(lower(text), '[A-Za-z]+') AS w FROM documents), c AS (SELECT doc_id, n::INT AS n, w[n * {size} + 1:n * {size} + {size}] AS w FROM d, unnest(range(len(w) // {size})) AS u(n))"


def _joined(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _papers(spark, sf):
    """doc_id, paper, pages: PER_PAPER questions a paper, in four layouts by turns."""
    c = _chunks(spark, sf, TAKE)
    w, number = F.col("w"), (F.col("n") % PER_PAPER + 1).cast("string")
    stem, o = F.array_join(F.slice(w, 1, WORDS), " "), [w[WORDS + i] for i in range(EACH)]
    answer = F.when(F.col("n") % 2 == 0, _joined("\nAns: ", F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("n") % 4 + 1).cast("int")))).otherwise("")
    letters = _joined(number, ". ", stem, *(x for i, k in enumerate("ABCD") for x in (f"\n({k}) ", o[i])), answer)
    numeric = _joined("Q.", number, ") ", stem, "\n", *(x for i in range(4) for x in (f"({i + 1}) ", o[i], " ")), answer)
    stated = _joined(number, ". ", stem, "\nA. ", o[0], "\nB. ", o[1], *(f"\n({i}) code {x}" for i, x in enumerate(("one", "two", "three", "four"), 1)), answer)
    sheet = _joined("Question Number : ", number, " Question Id : 7 Correct Marks : 1 ", stem, "\nOptions :\n", *(x for i, k in enumerate(("first", "second", "third", "fourth")) for x in (f"{i + 1}.\n{k} ", o[i], "\n")), answer)
    text = F.when(F.col("n") % 4 == 0, letters).when(F.col("n") % 4 == 1, numeric).when(F.col("n") % 4 == 2, stated).otherwise(sheet)
    # a paper is PER_PAPER questions, whatever the document's length
    own = c.groupBy("doc_id", F.floor(F.col("n") / PER_PAPER).cast("int").alias("paper")).agg(F.array_sort(F.collect_list(F.struct("n", text.alias("x")))).alias("q"))
    return own.select("doc_id", "paper", F.transform("q", lambda q: q["x"]).alias("pages"))


@query(f"""WITH {_chunks_sql(TAKE)}, q AS (SELECT *, array_to_string(w[1:{WORDS}], ' ') AS stem, n % 4 AS k, w[{WORDS} + 1:{TAKE}] AS o FROM c)
SELECT doc_id, n // {PER_PAPER} AS paper, n % {PER_PAPER} + 1 AS question_number, CASE k WHEN 2 THEN stem || ' A. ' || o[1] || ' B. ' || o[2] ELSE stem END AS question_text,
  CASE k WHEN 2 THEN 'code one' WHEN 3 THEN 'first ' || o[1] ELSE o[1] END AS option_a, CASE k WHEN 2 THEN 'code two' WHEN 3 THEN 'second ' || o[2] ELSE o[2] END AS option_b,
  CASE k WHEN 2 THEN 'code three' WHEN 3 THEN 'third ' || o[3] ELSE o[3] END AS option_c, CASE k WHEN 2 THEN 'code four' WHEN 3 THEN 'fourth ' || o[4] ELSE o[4] END || CASE WHEN n % 2 = 0 THEN chr(10) || 'Ans: ' || ['A', 'B', 'C', 'D'][n % 4 + 1] ELSE '' END AS option_d,
  CASE WHEN n % 2 = 0 THEN ['A', 'B', 'C', 'D'][n % 4 + 1] END AS correct_answer, FALSE AS needs_review, ['letters', 'numeric', 'numeric', 'lines'][k + 1] AS layout FROM q""")
def x23_d9_f21_question_papers(spark, sf):
    return P.parsed_questions(_papers(spark, sf), ["doc_id", "paper"], "pages")


PAIRS = 16


def _tables(spark, sf):
    """Match questions of four rows, two words a side; the right keys go 3, 1, 4, 2."""
    c = _chunks(spark, sf, PAIRS)
    two = lambda i: F.array_join(F.slice("w", 2 * i + 1, 2), " ")
    left, right = [two(i) for i in range(4)], [two(4 + i) for i in range(4)]
    keys, roman = "3142", ("iii", "I", "IV", "ii")
    wide = _joined("Match the following words:", *(x for i in range(4) for x in (f"\n{'ABCD'[i]}. ", left[i], f"   {keys[i]}. ", right[i])), "\nChoose the correct answer\nE. not a row")
    below = _joined("Match List I with List II", *(x for i in range(4) for x in (f"\n{'DCBA'[i]}. ", left[3 - i], f" {keys[3 - i]}.\n", right[3 - i])))
    mixed = _joined("Match the following", *(x for i in range(4) for x in (f"\n{'abcd'[i]}. ", left[i])), *(x for i in range(4) for x in (f"\n{roman[i]}. ", right[i])), "\nA-1, B-2")
    none = _joined("Match the following", "\nA. ", left[0], "\n1. ", right[0])
    k = F.col("n") % 4
    return c.select("doc_id", "n", F.when(k == 0, wide).when(k == 1, below).when(k == 2, mixed).otherwise(none).alias("question_text"))


@query(f"""WITH {_chunks_sql(PAIRS)}, p AS (SELECT *, list_transform(range(8), lambda i: w[2 * i + 1] || ' ' || w[2 * i + 2]) AS x FROM c WHERE n % 4 <> 3)
SELECT doc_id, n, CASE n % 4 WHEN 0 THEN 'Match the following words:' WHEN 1 THEN 'Match List I with List II' ELSE 'Match the following' END AS intro, array_to_string(x[1:4], '|') AS col1, array_to_string([x[6], x[8], x[5], x[7]], '|') AS col2 FROM p""")
def x28_match_tables(spark, sf):
    return P.match_tables(_tables(spark, sf), ["doc_id", "n"]).select("doc_id", "n", "intro", F.array_join("col1", "|").alias("col1"), F.array_join("col2", "|").alias("col2"))


def _quoted(x: str) -> str:
    return f"list_transform({x}, lambda y: '\"' || y || '\"')"


@query(f"""WITH {_chunks_sql(PAIRS)}, p AS (SELECT *, list_transform(range(8), lambda i: w[2 * i + 1] || ' ' || w[2 * i + 2]) AS x FROM c),
r AS (SELECT *, CASE WHEN n % 4 = 2 THEN [x[6], x[8], x[5], x[7]] ELSE x[5:8] END AS y FROM p)
SELECT doc_id, n, CASE WHEN n % 4 = 3 THEN 'no table' ELSE CASE n % 4 WHEN 2 THEN 'Match the columns' ELSE 'Pair these' END || chr(10) || chr(10) || '{Q.MATCH_MARK}' || '{{"col1": [' || array_to_string({_quoted('x[1:4]')}, ', ') || '], "col2": [' || array_to_string({_quoted('y')}, ', ') || ']}}' END AS question_text, CASE WHEN n % 4 = 3 THEN '' ELSE 'Match' END AS question_type FROM r""")
def x28_answer_sheet_tables(spark, sf):
    c = _chunks(spark, sf, PAIRS).withColumn("id", F.concat_ws("-", "doc_id", "n"))
    two = lambda i: F.array_join(F.slice("w", 2 * i + 1, 2), " ")
    left, right, k = [two(i) for i in range(4)], [two(4 + i) for i in range(4)], F.col("n") % 4
    inline = _joined("Pair these", *(x for i in range(4) for x in (f"\n{'ABCD'[i]}. ", left[i], f"    {i + 1}. ", right[i])))
    headed = _joined("Match the columns\nColumn I", *(x for i in range(4) for x in (f"\n{'ABCD'[i]}. ", left[i])), "\nColumn II", *(x for i in range(4) for x in (f"\n{('iii', 'i', 'iv', 'ii')[i]}) ", right[i])))
    rows = c.select("doc_id", "n", "id", F.when(k == 0, "Pair these").when(k == 1, inline).when(k == 2, headed).otherwise("no table").alias("question_text"), F.when(k == 3, "MCQ").when(k == 2, F.lit(None)).otherwise(" match ").alias("question_type"), F.when(k == 0, F.array(*left, F.lit(" "))).alias("match_left"), F.when(k == 0, F.array(*right)).alias("match_right"))
    return P.with_match_payload(rows).select("doc_id", "n", "question_text", "question_type")
