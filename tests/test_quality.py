"""Row quality on hand-written rows."""

import hashlib

from quizlake.operators import quality as Q

GOOD = dict(id="1", question_text="Which of these rivers is the longest?", option_a="Ganga", option_b="Yamuna", option_c="Krishna", option_d="Kaveri", question_number=4, exam_name="ABC Clerk", question_type=None, subject="Geography", topic="Rivers", subtopic="Length", correct_answer="a", answer_status=None, needs_review=False, has_image=False, image_url=None, explanation_status=None, is_active=True)
KINDS = ", ".join(f"{k} {'int' if k == 'question_number' else 'boolean' if k in ('needs_review', 'has_image', 'is_active') else 'string'}" for k in GOOD)
NO_OPTIONS = dict.fromkeys(Q.OPTIONS, " ")


def codes(spark, **changes):
    df = spark.createDataFrame([tuple((GOOD | changes).values())], KINDS)
    return df.select(Q.issue_codes()).first()[0]


def test_codes(spark):
    match = dict(option_a="1-A, 2-B", option_b="1-B, 2-A", option_c="A-1, B-2", option_d="A-2,B-1")
    cases = [
        ({}, []),
        (dict(question_number=None), ["unnumbered-questions"]),
        (dict(question_number=0, question_text=None), ["short-or-empty-text", "unnumbered-questions"]),
        (dict(option_d="\t"), ["incomplete-options"]),
        (NO_OPTIONS | dict(image_url="x"), ["answer-option-missing", "image-dependent-review"]),
        (dict(question_text="Look", has_image=True, image_url="x"), []),
        (dict(question_text="The roots are A) one B) two C) three D) four"), ["broken-extraction"]),
        (dict(question_text="Read the statements A) one B) two"), []),
        (dict(question_text="नदियों में सबसे लंबी कौन है"), ["regional-script"]),
        (dict(question_text="नदियों में सबसे लंबी कौन है", exam_name="UPSC Prelims"), []),
        (dict(question_text='Match the following __MATCH__: {"col1": ["a"], "col2": ["b"]}'), []),
        (dict(question_text='Match the following __MATCH__: {"col1": [], "col2": ["b"]}'), ["incomplete-match-columns"]),
        (dict(question_text='Match the following __MATCH__: {"col1": ["a"]}'), ["incomplete-match-columns"]),
        (dict(question_text="Match the following __MATCH__: {col1"), ["invalid-match-payload"]),
        (dict(question_text="Match the following __MATCH__: [1]"), ["invalid-match-payload"]),
        (match | dict(question_text="Match the following: pairs"), ["incomplete-match-stem"]),
        (match | dict(question_text="Match the following: list I has rivers and list II has their lengths"), []),
        (dict(needs_review=True, correct_answer="E"), ["answer-review", "invalid-answer"]),
        (dict(correct_answer=None, answer_status="Deleted"), []),
        (dict(subject="General Knowledge", topic=None, subtopic=" "), ["generic-subject-tag", "generic-topic-tag", "missing-subtopic-tag"]),
    ]
    for changes, want in cases:
        assert codes(spark, **changes) == want, changes


def test_state_and_repair(spark):
    rows = spark.createDataFrame([tuple(GOOD.values()), tuple((GOOD | dict(id="2", option_d=None, explanation_status="stale", is_active=False)).values())], KINDS)
    a, b = Q.with_quality(rows).orderBy("id").collect()
    assert (a.structural_status, a.answer_status, a.tagging_status, a.confidence_score, a.public_visibility, a.review_required) == ("valid", "verified", "strong", 100, "visible", False)
    assert (b.structural_status, b.explanation_status, b.confidence_score, b.public_visibility, b.primary_issue_code) == ("broken", "stale", 53, "hidden_structural", "incomplete-options")
    asked = rows.selectExpr("*", "'b) since' AS detected", "map('A', 'Ganga', 'D', 'Kaveri river') AS fixed")
    made = {(r.question_id, r.repair_type): r.proposed_patch for r in Q.repairs(asked, "detected", "fixed").collect()}
    assert made["1", "answer_correction"]["correct_answer"] == "B" and made["2", "options_cleanup"] == {"option_d": "Kaveri river", "needs_review": "true"} and len(made) == 4
    stored = Q.repairs(asked, "detected", "fixed").selectExpr("*", "monotonically_increasing_id() AS id", "current_timestamp() AS created_at")
    done = {r.id: r for r in Q.repaired(Q.with_quality(rows), stored).collect()}
    assert done["1"].correct_answer == "B" and done["1"].needs_review and done["1"].answer_status == "corrected" and done["1"].explanation_status == "stale"
    assert done["2"].issue_codes == ["answer-review", "incomplete-options"]


def test_cleaned(spark):
    texts = ["Which river नदी is  long?", "Do not open this question booklet", "no", "नदियों में सबसे लंबी कौन है abc de"]
    rows = spark.createDataFrame([tuple((GOOD | NO_OPTIONS | dict(question_text=x)).values()) for x in texts], KINDS)
    assert [r.question_text for r in Q.cleaned(rows).collect()] == ["Which river is long?"]
    assert rows.select(Q.extraction_score()).collect()[1][0] < -1000


def test_baseline(spark):
    made = [(2, "E", 2020, " ", True, None, True, True, "broken"), (10, "E ", 2020, None, None, None, None, False, None), (1, "E", 2020, "NO_SHIFT", True, "hidden_admin", False, None, "valid"), (3, "E", None, "S1", False, "visible", True, False, "valid")]
    rows = spark.createDataFrame(made, "id long, exam_name string, exam_year int, shift_label string, is_active boolean, public_visibility string, practice_ready boolean, needs_review boolean, structural_status string")
    got = {(r.exam_name, r.exam_year, r.shift_label): tuple(r)[3:] for r in Q.baseline(rows, spark.createDataFrame([(2,), (2,), (3,), (77,)], "question_id long")).collect()}
    assert got == {("E", 2020, "NO_SHIFT"): (3, 2, 1, 2, 1, 1, 1, 1, ["1", "10", "2"], hashlib.sha256(b"1\n10\n2").hexdigest()), ("E", 0, "S1"): (1, 0, 1, 0, 1, 0, 0, 1, ["3"], hashlib.sha256(b"3").hexdigest())}
