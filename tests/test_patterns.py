"""Question patterns on hand-written rows."""

from quizlake.operators import patterns as P

COLUMNS = ("question_text", *P.OPTIONS, "subject", "topic", "subtopic")
KINDS = ", ".join(f"{c} string" for c in COLUMNS)
LONG = "Several farmers of that region were seen " + "walking slowly home " * 6


def test_cascades(spark):
    cases = [
        (dict(question_text="Match the following lists"), ("match-the-following", "code-pair-confusion", "analysis", "analytical", 96)),
        (dict(question_text="Assertion: rain falls. Reason: clouds form"), ("assertion-reason", None, "analysis", "analytical", 96)),
        (dict(question_text="Fill in the blank with a verb", subject="English Language"), ("fill-in-the-blank", "tense-agreement", "language-usage", "language", 88)),
        (dict(question_text="Fill in the blank with a king", subject="History"), ("factual-recall", None, "recall", "direct", 74)),
        (dict(question_text="Spot the error", subject="History"), ("grammar-error-detection", "tense-agreement", "language-usage", "language", 88)),
        (dict(question_text="Pick one", subject="English", topic="Vocabulary"), ("vocabulary-usage", None, "language-usage", "language", 86)),
        (dict(question_text="The HCF of 12 and 18"), ("gcd-lcm-calculation", "formula-confusion", "calculation", "quantitative", 94)),
        (dict(question_text="The body was established in the year ____ by a committee"), ("date-event-recall", "close-dates", "recall", "direct", 88)),
        (dict(question_text="Consider the following statements, which are wrong?", option_a="1 and 2"), ("statement-elimination", "negation", "elimination", "indirect", 92)),
        (dict(question_text="Consider the following statements, only one holds"), ("statement-based", "absolute-wording", "analysis", "analytical", 92)),
        (dict(question_text="Who came first in 1999"), ("factual-recall", None, "recall", "direct", 74)),
        (dict(question_text=LONG), (None,) * 5),
        (dict(question_text=" \t"), (None,) * 5),
        (dict(), (None,) * 5),
    ]
    df = spark.createDataFrame([tuple(case.get(c) for c in COLUMNS) for case, _ in cases], KINDS).coalesce(1)
    got = P.classified(df).collect()
    for row, (case, (tag, trap, skill, style, confidence)) in zip(got, cases, strict=True):
        want = (tag, trap, skill, style, confidence, tag and P.REASON[tag], tag and "rules")
        assert (row.pattern_tag, row.trap_tag, row.skill_tag, row.question_style, row.pattern_confidence, row.pattern_reason, row.pattern_source) == want, case
    assert got[9].solve_hint == P.HINT["statement-based"] + P.TRAP_HINT["absolute-wording"]
    assert got[8].solve_hint == P.HINT["statement-elimination"] + P.NEGATIVE_HINT


def test_own_columns_are_replaced(spark):
    df = spark.createDataFrame([("x", *[None] * 7, "old", 1)], KINDS + ", pattern_tag string, extra int")
    row = P.classified(df).first()
    assert (row.pattern_tag, row.extra) == ("factual-recall", 1)
