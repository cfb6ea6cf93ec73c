"""The editors' desk and the snapshots on hand-written rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quizlake.operators import desk as D
from quizlake.sources import snapshots as S
from test_quality import GOOD, KINDS


def bank(spark, *changes):
    return spark.createDataFrame([tuple((GOOD | c).values()) for c in changes], KINDS)


@pytest.mark.parametrize("labels, subject, concept", [(("Polity", "", None), "Polity", "General"), ((None, "Basics", "mixed"), "General Knowledge", "General"), (("Maths", "Series", ""), "Maths", "Series"), (("Law", "Land  reform (old) state specific", "Tenancy"), "Law", "Land reform State Specific"), (("Law", "Courts", "court"), "Law", "Courts"), (("X", "The Indus", "x"), "History", "Indus Valley Civilization"), (("X", "Lakes", "Causes of floods"), "X", "Lakes"), (("X", "Repo rate", "x"), "X", "Monetary Policy")])
def test_client_taxonomy(spark, labels, subject, concept):
    df = spark.createDataFrame([labels], "a string, b string, c string")
    got = df.select(D.client_subject("a", "b", "c"), D.client_concept("a", "b", "c")).first()
    assert tuple(got) == (subject, concept)


def test_edits(spark):
    rows = bank(spark, {}, dict(id="2"), dict(id="3", is_active=False), dict(id="4"))
    edits = spark.createDataFrame([("1", {"correct_answer": "C"}), ("2", {"subject": "Telangana History"}), ("3", {"question_text": "Look"})], "id string, patch map<string,string>")
    told = spark.createDataFrame([("1",), ("2",), ("4",)], "question_id string")
    new, left = D.edited(rows, edits, told)
    new = {r.id: r for r in new.collect()}
    assert sorted(new) == ["1", "2", "3"] and sorted(r[0] for r in left.collect()) == ["2", "4"]
    assert new["1"].correct_answer == "C" and new["1"].public_visibility == "visible" and not new["1"].review_required
    assert new["2"].subject == "Telangana History" and new["2"].canonical_subject == "History" and new["1"].canonical_subject is None
    assert new["3"].structural_status == "broken" and new["3"].public_visibility == "hidden_structural"


def test_manual_rows(spark):
    asked = spark.createDataFrame([("E", None, None, None), ("E", 2020, 7, False)], "exam_name string, exam_year int, question_number int, needs_review boolean")
    a, b = D.manual_rows(asked, "1970-01-01 00:01:00").orderBy("exam_year", ascending=False).collect()
    assert (a.exam_year, a.question_hash, a.question_text, a.needs_review, a.is_active) == (2024, "manual_60_1", "New Blank Question", True, True)
    assert (b.exam_year, b.question_hash, b.needs_review) == (2020, "manual_60_7", False)


def test_explanations(spark):
    rows = spark.createDataFrame([("1", "deleted", ["A", "B"], "x"), ("2", None, ["A", "B"], "x"), ("3", None, ["A"], ""), ("4", None, None, "The correct answer is B."), ("5", None, None, "It is so.")], "id string, answer_status string, correct_answers array<string>, explanation string")
    got = rows.select("id", D.explanation_source("explanation", F.col("id") == "4")).collect()
    assert dict(map(tuple, got)) == {"1": "deleted-question", "2": "multiple-correct-answers", "3": "unavailable-error", "4": "hidden-contradiction", "5": None}
    bank_ = spark.createDataFrame([("1", "A", False), ("2", "A", True), ("3", "A", False), ("4", "A", False)], "id string, correct_answer string, needs_review boolean")
    told = spark.createDataFrame([("1", "fine", "unverified-answer"), ("2", " fine ", "unverified-answer"), ("3", "The correct answer is B.", None), ("4", "x [FLAG: verify answer]", None), ("9", "fine", "unverified-answer"), ("8", "fine", None), ("7", " ", None)], "question_id string, explanation string, source string")
    ids = spark.createDataFrame([(str(k), k) for k in range(1, 10)] + [("2", 1)], "id string, place int")
    assert sorted(map(tuple, D.safe_explanations(bank_, told, ids).collect())) == [("2", "fine"), ("8", "fine")]


def test_files(spark):
    exams = spark.createDataFrame([("CISF Head Constable", 2021, None), ("Nothing alike", None, ""), ("Group 4 Services", 2018, "in\\gp_x.final.pdf")], "exam_name string, exam_year int, source_pdf string")
    files = spark.createDataFrame([("cisf-2021.pdf",), ("cisf.pdf",), ("gp_iv.pdf",), ("nothing.pdf",)], "name string")
    got = {r.exam_name: (r["name"], r.score) for r in D.matched_files(exams, files).collect()}
    # a word, the year as a word and in the name, and the hint; the hint alone; one word alone is too little
    assert got == {"CISF Head Constable": ("cisf-2021.pdf", 53), "Group 4 Services": ("gp_iv.pdf", 35)}


def test_chunks_and_bookmarks(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "exam_key string, id int, question_number int, position int")
    cached, batch = rows(("e", 1, 5, 0), ("e", 2, None, 1)), rows(("e", 1, 1, 0), ("e", 3, 5, 1), ("f", 1, None, 2))
    got = D.chunk_merged(cached, batch).orderBy("exam_key", "place").collect()
    assert [(r.exam_key, r.id, r.question_number) for r in got] == [("e", 1, 5), ("e", 3, 5), ("e", 2, None), ("f", 1, None)]
    assert [r.id for r in D.chunk_merged(cached, batch, replace=True).where("exam_key = 'e'").orderBy("place").collect()] == [1, 3]
    marks = lambda *x: spark.createDataFrame(list(x), "uid string, question_id string, note string, at int")
    out = D.bookmarked(marks(("u", "a", "old", 1), ("u", "b", "old", 1)), marks(("u", "a", "x", 2), ("u", "a", "y", 3)), marks(("u", "b", None, 9)))
    assert [tuple(r) for r in out.collect()] == [("u", "a", "y", 3)]


def test_retagged_keeps_rows(spark):
    rows = bank(spark, dict(subject="Telangana History"), dict(id="2", exam_name="Other"))
    told = spark.createDataFrame([("1",), ("1",)], "question_id string")
    (r,) = D.retagged(rows, told, "ABC Clerk").collect()
    assert (r.subject, r.raw_subject, r.explanation_status) == ("History", "Telangana History", "generated")


def test_empty_tables(spark):
    rows, told = bank(spark, {}).limit(0), spark.createDataFrame([], "question_id string")
    assert D.stored_state(rows, told).count() == 0 and D.sanitised(rows.withColumn("public_visibility", F.lit("x"))).count() == 0
    assert D.published(rows.withColumn("exam_year", F.lit(1))).count() == 0 and D.stale_explanations(rows, told).count() == 0


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    spark.range(3).write.parquet(path)
    assert S.scan(spark, path, ["id", "other"]).columns == ["id"] and S.scan(spark, path).count() == 3
    assert S.lookup(S.scan(spark, path), 2).first()[0] == 2
    folder = tmp_path / "reports"
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        S.json_artifact(spark, str(folder))
    for name in ("b", "a"):
        (folder / f"{name}.json").write_text(json.dumps({"name": name}, indent=1))
        time.sleep(1.1)
    assert S.json_artifact(spark, str(folder)).first()["name"] == "a"
    assert S.json_artifact(spark, str(folder), "../x/b.json").first()["name"] == "b"
