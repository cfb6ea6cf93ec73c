"""What keeps joins and texts of many rows cheap, and right beside it."""

import random

import pytest
from pyspark.sql import functions as F
from test_upgrades import grams, likeness

from quizlake.operators import answer_keys as A
from quizlake.operators import similar


def test_similar_pairs_are_bounded_before_they_are_counted(spark):
    df = spark.createDataFrame([(x,) for x in ("river delta", "river deltas", "lake")], "x string")
    for found in (similar.similar_pairs(df, "x", 0.5), similar.search(df, "x", df, "x", 0.5)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join Inner" in line]
        assert len(joins) == 1 and "array_intersect" not in joins[0] and "bit_count" in joins[0]


@pytest.mark.parametrize("share", [0.4, 0.5, 2 / 3])
def test_similar_pairs_of_long_and_rare_texts(spark, share):
    """More trigrams than marks, sets of very different sizes, letters beyond the basic plane."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(90)]
    long = [" ".join(rng.sample(words, 80)) for _ in range(6)]
    texts = long + [" ".join(x.split()[:n]) for x in long[:3] for n in (30, 40, 41, 54)] + ["\U0001d4b6\U0001d4b7", "\U0001d4b6\U0001d4b7 \U0001d4b8", "a", "a b", "a b c", "ab", "abc"]
    got = similar.similar_pairs(spark.createDataFrame([(x,) for x in texts], "x string"), "x", share).collect()
    different = sorted({x for x in texts if grams(x)})
    want = {(a, b): likeness(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if likeness(a, b) >= share - 1e-12}
    assert {(r.text_a, r.text_b): pytest.approx(r.similarity) for r in got} == want and len(got) == len(want)


def test_answer_sets_are_read_once(spark):
    keys = spark.createDataFrame([("1-A 2-B", 2)], "text string, n int")
    plan = A.by_set(keys, "text", "n").select(F.inline("sets"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(filter(" not in plan and "Filter (size(sets" in plan


def test_answer_sets_of_each_way_side_by_side(spark):
    cases = [
        ("SET A 1-C 2-B SET B 1-A 2-D", 0, {"A": {1: "C", 2: "B"}, "B": {1: "A", 2: "D"}}),
        ("SET A 1-C SET A 2-D", 2, dict.fromkeys("ABCD", {1: "C", 2: "D"})),
        ("SET A nothing\n1 A B C D\n1 D C B A", 1, {"A": {1: "D"}, "B": {1: "C"}, "C": {1: "B"}, "D": {1: "A"}}),
        ("1 A B C D", 4, dict.fromkeys("ABCD", {1: "A"})),  # a quarter covered is too little for columns
        ("1 A B C D 7 A A A A", 3, {k: {1: k, 7: "A"} for k in "ABCD"}),
        ("9-B", None, dict.fromkeys("ABCD", {9: "B"})),
        ("", 5, dict.fromkeys("ABCD", {})),
        (None, 0, dict.fromkeys("ABCD", {})),
    ]
    keys = spark.createDataFrame([(i, text, n) for i, (text, n, _) in enumerate(cases)], "i int, text string, n int")
    got = {r.i: {s.label: {a.number: a.answer for a in s.answers} for s in r.sets} for r in A.by_set(keys, "text", "n").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
