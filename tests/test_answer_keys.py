"""Answer keys on hand-written texts."""

from pyspark.sql import functions as F

from quizlake.operators import answer_keys as A


def read(spark, text, make):
    return {r.number: r.answer for r in spark.createDataFrame([(text,)], "text string").select(make("text").alias("a")).first().a}


def test_layouts(spark):
    best = lambda n: lambda c: A.parsed(c, F.lit(n))
    cases = [
        (None, 5, {}),
        ("", 0, {}),
        ("1.A  2-(b) 3)C 4:4 Q.5 - d", 5, {1: "A", 2: "B", 3: "C", 4: "D", 5: "D"}),
        ("1 A 51 C\n2 x\n1 B", 0, {1: "A", 2: "DELETED", 51: "C"}),
        ("Q.No.1 Ans A\nQuestion 2 Answer: (B)\nAns to Q3: C", 3, {1: "A", 2: "B", 3: "C"}),
        ("0-A 301-B 300-C 1234-A", 300, {300: "C"}),
        ("1 A\n2 B\n3-C", 3, {1: "A", 2: "B"}),
    ]
    for text, n, want in cases:
        assert read(spark, text, best(n)) == want, text


def test_special(spark):
    assert read(spark, "82 X\n83-x\n97 B or C\n98 Bor C\n99 B/C\n100 A A\n82 B/C", A.special) == {82: "DELETED", 83: "DELETED", 97: "B|C", 98: "B|C", 99: "B|C"}
    assert read(spark, "1 A\n2 X\n3 B/C", lambda c: A.merged(A.by_strategy(c, "tabular"), A.special(c))) == {1: "A", 2: "DELETED", 3: "B|C"}


def test_sets(spark):
    def sets(text, n):
        row = A.by_set(spark.createDataFrame([(text, n)], "text string, n int"), "text", "n").first()
        return {s.label: {a.number: a.answer for a in s.answers} for s in row.sets}

    assert sets("Key\nSET A: 1-C 2-B\nSeries B 1-A 2-D\nset a nothing", 2) == {"A": {1: "C", 2: "B"}, "B": {1: "A", 2: "D"}}
    assert sets("1 A B C D\n2 1 2 3 4\n1 B B B B", 2) == {k: {1: "B", 2: k} for k in "ABCD"}
    assert sets("1-A 2-B", 2) == {k: {1: "A", 2: "B"} for k in "ABCD"}
    assert sets(None, None) == {k: {} for k in "ABCD"}


def test_paper_set(spark):
    found = lambda *pages: spark.createDataFrame([(list(pages),)], "p array<string>").select(A.paper_set("p")).first()[0]
    assert found("x", "Series : c", "SET A") == "C" and found("x", None, "y", "SET A") is None and found("SET AB", "Code.D") == "D"
    assert spark.createDataFrame([(None,), ([],)], "p array<string>").select(A.paper_set("p")).collect() == [(None,), (None,)]
