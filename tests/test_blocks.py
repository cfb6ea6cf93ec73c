"""Raw blocks on hand-written rows."""

from quizlake.operators import blocks as B

GOOD = dict(question_number_raw="12", raw_block_text="Which of these rivers of India is the longest one of all?", raw_options_text="A) a\nB) b\nC) c\nD) d", line_count=5, extraction_confidence=0.9, mixed_block_confidence=0.9, option_isolation_confidence=0.9, options_recovered_count=4, merged_question_risk=False, boundary_detection_note=None, source_page_type=None)
KINDS = "question_number_raw string, raw_block_text string, raw_options_text string, line_count int, extraction_confidence double, mixed_block_confidence double, option_isolation_confidence double, options_recovered_count int, merged_question_risk boolean, boundary_detection_note string, source_page_type string"


def test_audit(spark):
    cases = [
        ({}, "ready_for_phase_c", []),
        (dict(question_number_raw="12a"), "withhold_for_now", ["implausible_question_number"]),
        (dict(raw_options_text=None, options_recovered_count=3), "ready_for_phase_c", ["partial_options"]),
        (dict(raw_options_text=" A) a", options_recovered_count=None), "withhold_for_now", ["option_incomplete"]),
        (dict(raw_block_text="Find x + 1234", line_count=2), "needs_manual_review", ["question_text_short", "short_block_shape"]),
        (dict(raw_block_text=GOOD["raw_block_text"] + " Solution: a = b / c + d"), "withhold_for_now", ["possible_solution_leakage", "strong_solution_leakage"]),
        (dict(boundary_detection_note="mixed_page cut", mixed_block_confidence=0.75, source_page_type="mixed_special_page"), "needs_manual_review", ["mixed_page_recovery", "mixed_page_recovery_risk"]),
        (dict(extraction_confidence=None), "withhold_for_now", ["very_low_extraction_confidence"]),
    ]
    for changes, status, reasons in cases:
        row = B.audited(spark.createDataFrame([tuple((GOOD | changes).values())], KINDS)).first()
        assert (row.status, row.failure_reasons) == (status, reasons), changes


def test_ready(spark):
    rows = spark.createDataFrame([tuple(GOOD.values()), tuple((GOOD | dict(line_count=None, option_isolation_confidence=0.6)).values())], KINDS)
    assert B.ready(B.audited(rows)).count() == 1 and B.audited(rows.limit(0)).count() == 0


def test_stabilised(spark):
    def order(*numbers):
        rows = spark.createDataFrame([(1, i, n, 10 * i) for i, n in enumerate(numbers)], "page int, i int, question_number_raw string, y0 int")
        return [r.question_number_raw for r in B.stabilised(rows, ["page"], "i").orderBy("place").collect()]

    assert order("101", "3", "102", None, "103") == ["101", "102", None, "103"]
    assert order("4", "x", "3", "5") == ["3", "4", "5", "x"]
    assert order("4", "3", "3") == ["4", "3", "3"] and order("60") == ["60"] and order(None, None) == [None, None]
    assert order("40", "3") == ["3", "40"]
