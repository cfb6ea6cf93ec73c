"""Question blocks, options and match tables: each branch by a row, the scan against plain patterns on real texts."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quizlake.operators import questions as P

SF = "/root/testdata/sf0.001"
PLAIN = re.compile(r"^\s*(?:(?:Q\.?\s*)?(\d{1,3})[.)]|Question\s+Number\s*[:.-]\s*(\d{1,3})[.)]?)\s*(.*)", re.MULTILINE | re.IGNORECASE)
FOUR = "\n(A) red\n(B) blue\n(C) green\n(D) grey"


def parsed(spark, *papers):
    df = spark.createDataFrame([(i, [p] if isinstance(p, str) else p) for i, p in enumerate(papers)], "id int, pages array<string>")
    out = [[] for _ in papers]
    for r in sorted(P.parsed_questions(df, ["id"], "pages").collect(), key=lambda r: r.question_number):
        out[r.id].append(r)
    return out


def numbers(*texts):
    return [[n for n, _ in P.question_starts(t)] for t in texts]


def test_scan_finds_what_plain_patterns_find(spark):
    rows = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + [re.sub("<[^>]*>", "\n", r[0]) for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    made = [re.sub(r"(\w+)\. ", lambda m: f"{m[1]}.\n{len(m[1])}. " if len(m[1]) % 3 else f"{m[1]}.\n\n  \nQ{len(m[1])})\n", t) for t in rows]
    odd = ["", "\n\n", "1.", "1.\n\n2. x", " 1)\n\n\n(x)\n3. y", "Question Number : 4 x\nquestion number-5\n6", "q. 7. a\nQ.8) b\n 9. c", "1234. no\n12 . no\nx 1. no", "Q.\n5. over two lines"]
    for text in rows + made + odd:
        assert [(s, n, e) for s, n, e in P.candidates(text)] == [(m.start(), m[1] or m[2], bool(m[2])) for m in PLAIN.finditer(text)]


def test_question_starts():
    gap = "\n\nsome words that fill the line so that the next number is far from the start\n\n"
    assert numbers("1. a\n\n2. b", f"1. a{gap}21. b", f"1. a{gap}22. b", f"5. a{gap}4. b{gap}6. c") == [[1, 2], [1, 21], [1], [5, 6]]
    # lost first digits count as the next number after a blank line only, and not after an introduction
    forty = "".join(f"{i}. q{gap}" for i in range(1, 42))
    assert numbers(forty + "2. lost")[0][-1] == 42 and numbers(forty + "x\nfar from a blank line, on and on\n2. no")[0][-1] == 41 and numbers(forty + "which statements:\n\n2. no")[0][-1] == 41
    # statements inside a question are none, unless they say what they are
    inside = "1. Consider the following statements about rivers and about lakes and hills\n2. one long statement\n3. another long one"
    assert numbers(inside, inside.replace("2. one", "Question Number : 2 one")) == [[1], [1, 2]]
    assert numbers("1. A plain question that holds only words and no numbers, and that goes on\nfor two lines\n2. the next") == [[1, 2]]


def test_layouts(spark):
    stem = "What colour has the sky today"
    got = parsed(
        spark,
        f"1. {stem}?{FOUR}\n\n2. {stem} (again)?\n(1) red (2) blue (3) green (4) grey\nAnswer: (3)",
        f"7. {stem}, of these?\nA. one thing\nB. other thing\n(1) A only\n(2) B only\n(3) both\n(4) neither\nAns - 2",
        "Question Number : 3 Question Id : 77 Display : x Correct Marks : 1\nWhat do we see there\nOptions :\n1.\nRed\nred\n2. \nBlue one\nOption Shuffling : no\nGreen\nGrey\nBrown\nAns: d",
        f"1. {stem}?\nAns: B", "1. short?" + FOUR, f"1. Candidates must write your name before {stem}" + FOUR, None, [], [None, f"4. {stem}?", FOUR.strip()], f"1. {stem}?\n(a) x\n(b) \n(c) y",
    )
    one, two = got[0]
    assert (one.layout, one.question_text, one.option_a, one.option_d, one.correct_answer, one.needs_review) == ("letters", f"{stem}?", "red", "grey", None, False)
    assert (two.layout, two.option_b, two.option_d, two.correct_answer) == ("numeric", "blue", "grey\nAnswer: (3)", "C")
    assert [(r.layout, r.question_text, r.option_a, r.option_d, r.correct_answer) for r in got[1]] == [("numeric", f"{stem}, of these? A. one thing B. other thing", "A only", "neither\nAns - 2", "B")]
    assert [(r.question_text, r.option_a, r.option_b, r.option_c, r.option_d, r.correct_answer) for r in got[2]] == [("What do we see there", "Red", "Blue one", "Green", "Grey", "D")]
    assert got[3] == got[4] == got[5] == got[6] == got[7] == []
    assert [r.option_c for r in got[8]] == ["green"] and [(r.option_a, r.option_b, r.needs_review) for r in got[9]][0][2]


def test_winner_fragment_and_picture(spark):
    got = parsed(spark, f"1. Which of the colours is best?\n(A) red\n(B) blue\n\nx y z\n\n2. All of the above{FOUR}\n\n3. Study the following graph with care{FOUR}")[0]
    assert [(r.question_number, r.needs_review) for r in got] == [(1, True), (3, True)]
    rows = spark.createDataFrame([(1, 0, 5, "short", "a", "b", "", ""), (1, 1, 5, "a longer stem", "a", "", "", ""), (1, 2, 5, "shorx", "a", "b", "", ""), (1, 3, 6, "s", "", "", "", "")], "id int, position int, question_number int, question_text string, option_a string, option_b string, option_c string, option_d string")
    assert sorted((r.question_number, r.position) for r in P.best_by_number(rows, ["id"]).collect()) == [(5, 0), (6, 3)]


@pytest.mark.parametrize("text, want", [
    ("Neither A nor B\nA.\nB.", "Neither A nor B"), ("river (1) A only (2) B", "river"), ("river (1) rose last week and " + "x" * 100, "river (1) rose last week and " + "x" * 100), ("lake\nWhich of the above is right?", "lake"),
    ("hill ET 22 X M A S T E R", "hill"), ("hill MASTER COPY 3", "hill"), ("wood తెలుగు text", "wood"), ("é wood", "é wood"), ("plain", "plain"), ("", ""),
])
def test_option_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(P.option_text(F.col("x"))).first()[0] == want


def tables(spark, *texts, headed=False):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, question_text string")
    return {r.id: (r.intro, r.col1, r.col2) for r in P.match_tables(df, ["id"], headed=headed).collect()}


def test_match_tables(spark):
    head = "Match the following:"
    got = tables(
        spark,
        f"{head}\nB. Delhi   2. Yamuna\nA. Agra   10. Taj\nChoose the correct answer\nC. no  3. no",
        f"List I and List II are given\na. one IV. four\nb. two  \nIX. nine\nc. three 1.\nwide\nd. four 2.\n3. own key",
        f"{head}\nA. x\nB. y\nC. z\n2. q\n1. p",
        f"{head}\nA. x\nB. y\n1. p", "no prompt\nA. x\nB. y\n1. p\n2. q", f"{head}\nA. x 1. p\nB. y 2. q __MATCH__:{{}}", None, "",
        "The writer of\nA. x\t\t1. p\nB. y\t2. \"q\"\\",
    )
    assert got[0] == (head, ["Agra", "Delhi"], ["Yamuna", "Taj"])
    assert got[1] == ("List I and List II are given", ["one", "two", "three", "four"], ["wide", "own key", "four", "nine"])
    assert got[2] == (head, ["x", "y", "z"], ["p", "q"])
    assert set(got) == {0, 1, 2, 8} and got[8] == ("The writer of", ["x", "y"], ["p", '"q"\\'])


def test_headed_tables(spark):
    got = tables(spark, "Match the columns\nColumn I\nB. y\nA. x\nList 2\nii) two\ni) one\nc. three", "Match column one\nA. x    2. q\nB. y    1. p\nA. 1-2, B. no", "Match list\nI. first\nII. second\n2. b\n1. a", "match the columns\n1. a\n2. b\nA. x\nB. y", headed=True)
    assert got == {0: ("Match the columns", ["x", "y"], ["one", "two", "three"]), 1: ("Match column one", ["x", "y"], ["p", "q"]), 2: ("Match list", ["first", "second"], ["a", "b"])}


def test_answer_sheet_payload(spark):
    flat = "Match the following athletes:\nA. Runner one    1. Discus\nB. Boxer two    2. Ring"
    rows = [(1, "Match these:", "match", ["a", " ", "b"], ["c", "d"]), (2, flat, "match", None, None), (3, flat, None, None, None), (4, "plain", " Match ", ["a"], []), (5, "plain", "mcq", None, None), (6, None, "match", ["a", "b"], ["c", "d"]), (None, "plain", None, None, None)]
    out = {r.id: r for r in P.with_match_payload(spark.createDataFrame(rows, "id int, question_text string, question_type string, match_left array<string>, match_right array<string>")).collect()}
    assert len(out) == len(rows) and out[1].question_text == 'Match these:\n\n__MATCH__:{"col1": ["a", "b"], "col2": ["c", "d"]}'
    for i in (2, 3):
        stem, payload = out[i].question_text.split("\n\n__MATCH__:")
        assert stem == "Match the following athletes:" and json.loads(payload) == {"col1": ["Runner one", "Boxer two"], "col2": ["Discus", "Ring"]} and out[i].question_type == "Match"
    assert [(out[i].question_text, out[i].question_type) for i in (4, 5, None)] == [("plain", "Match"), ("plain", ""), ("plain", "")] and out[6].question_text.startswith("Match the following:\n\n")


def test_long_texts_stay_linear():
    import time

    began = time.time()
    P.question_starts("\n \n" * 200_000 + "1. x\n" * 50_000)
    P.table_entries("A. x 1.\n" * 100_000)
    assert time.time() - began < 20
