"""Text of scanned papers on hand-written rows: nulls, empty texts, every branch."""

import pytest
from pyspark.sql import functions as F

from quizlake.operators import blocks as B
from quizlake.operators import extraction as E


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


def isolate(spark, text):
    return E.isolated(spark.createDataFrame([(text,)], "raw_block_text string")).first()


@pytest.mark.parametrize(
    "text, stem, options, anchors, confidence, notes",
    [
        (None, "", {}, [], 0.0, ["empty_raw_block"]),
        ("\n \t\n", "", {}, [], 0.0, ["empty_raw_block"]),
        ("A question without options", "A question without options", {}, [], 0.0, []),
        ("Which is the longest?\r\nA. one\r\nB. two\r\nC. three\r\nD. four", "Which is the longest?", {"A": "one", "B": "two", "C": "three", "D": "four"}, ["A", "B", "C", "D"], 0.9, []),
        # a letter that comes again goes on with its option; the order of first occurrence counts
        ("Which is the longest?\n(a) one - (b) two\n(a) more", "Which is the longest?", {"A": "one\nmore", "B": "two"}, ["A", "B", "A"], 0.62, []),
        # letters inside of words are no anchors; text before an anchor on a later line belongs to the option before
        ("Vitamin-A. and DNA) of cells\nA) first\nlast of it B) second", "Vitamin-A. and DNA) of cells", {}, None, None, None),
        ("Which is the longest?\nA)\nB)", "Which is the longest?", {}, ["A", "B"], 0.45, ["empty_option_anchor", "anchors_without_option_text"]),
        ("Tiny C) x", "Tiny", {"C": "x"}, ["C"], 0.37, ["stem_short"]),
    ],
)
def test_isolated(spark, text, stem, options, anchors, confidence, notes):
    r = isolate(spark, text)
    if anchors is None:  # "-A." is an anchor, since only letters and digits may not stand before one
        assert r.stem_text == "Vitamin-" and r.options == {"A": "and DNA) of cells\nfirst\nlast of it", "B": "second"} and "wrapped_option_line" in r.isolation_notes
        return
    assert (r.stem_text, r.options, r.option_anchors, r.isolation_notes) == (stem, options, anchors, notes)
    assert r.option_isolation_confidence == pytest.approx(confidence) and r.options_recovered_count == len(options)


def test_audit_over_isolation_and_drafts(spark):
    good = "12. Which of the rivers is the longest of all?\nA) one\nB) two\nC) three\nD) four"
    rows = [(good, "12"), (good, "0"), ("12.\nA) one\nB) two\nC) three\nD) four", "12"), (None, None)]
    blocks = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw_block_text string, question_number_raw string")
    blocks = blocks.withColumns({"raw_options_text": F.lit("A) B) C) D)"), "line_count": F.lit(5), "extraction_confidence": F.lit(0.9), "mixed_block_confidence": F.lit(0.9), "merged_question_risk": F.lit(False), "boundary_detection_note": F.lit(None).cast("string"), "source_page_type": F.lit(None).cast("string")})
    done = {r.i: r for r in E.audited(blocks).collect()}
    assert done[0].status == B.STATUS[0] and done[1].status == B.STATUS[6] and done[3].status == B.STATUS[6]
    made = {r.i: r for r in E.drafts(E.isolated(blocks).withColumn("status", F.lit(B.STATUS[0]))).collect()}
    assert (made[0].question_number, made[0].question_text, made[0].option_d, made[0].failure) == (12, "Which of the rivers is the longest of all?", "four", None)
    assert made[0].normalization_notes == [] and made[2].failure == "normalized_stem_missing_after_number_strip" and made[3].failure == "normalized_options_missing"


def test_reasons_are_ranked(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (1, ["b"]), (2, ["a"]), (2, [])], "page_number int, failure_reasons array<string>")
    assert {r.page_number: r[1] for r in E.top_reasons(rows, ["page_number"], 1).collect()} == {1: ["b:2"], 2: ["a:1"]}
    assert E.top_reasons(rows, [], 5).first()[0] == ["a:2", "b:2"]


def test_page_kinds_of_empty_pages(spark):
    kinds = "text string, top_text string, column_count int, has_diagram boolean, image_count int, drawing_count int, text_block_count int"
    rows = [(None, None, None, None, None, None, None), ("", "", 2, True, 0, 0, 0), ("free pdf hall free pdf hall", "TABLE OF IT", 1, True, 0, 0, 1)]
    got = [(r.page_type, r.confidence, r.heading, r.reasons) for r in E.page_kinds(spark.createDataFrame(rows, kinds)).collect()]
    assert got[0] == ("mixed_special_page", 0.64, None, []) and got[1] == ("mixed_special_page", 0.64, None, ["columns=2", "visual_density_or_diagram"])
    assert got[2][:3] == ("ignore_noisy_page", 0.94, "TABLE OF IT") and "watermark_dominant" in got[2][3]


def test_formats_without_pages(spark):
    x = E.paper_format("pages", "name")
    assert one(spark, x, pages=[], name=None) == "scanned_image"
    assert one(spark, x, pages=["x" * 300] * 3 + ["the initial key of it"], name="appsc_initialkey.pdf") == "appsc_boxed"
    assert one(spark, x, pages=["x" * 300] * 3 + ["the initial key of it"], name="other.pdf") == "digital_mcq"


@pytest.mark.parametrize("subject, raw, want", [(None, "x", "x"), ("S", None, None), ("S", "", ""), ("S", " ", "Heat of It"), ("S", "HEAT OF IT", "Heat of It"), ("S", "heat", "Heat of It"), ("S", "sound and light", "Light"), ("S", "a tone", "Waves"), ("S", "big waves theory law", "Waves"), ("S", "law of nothing", "Law of Large Things"), ("S", "zzz", "zzz")])
def test_topic_bucket(spark, subject, raw, want):
    topics = {"S": ["Heat of It", "Light", "Waves", "Law of Large Things"]}
    assert one(spark, E.topic_bucket("subject", "raw", topics, {"S": {"tone": "Waves"}}), subject=subject, raw=raw) == want


def test_year_spans(spark):
    rows = [("d", 1, None), ("d", 2, "UPSC 2019"), ("d", 3, ""), ("d", 4, "2018 2019"), ("d", 5, "2019"), ("e", 1, "1999")]
    got = E.year_spans(spark.createDataFrame(rows, "document string, page int, footer string")).collect()
    assert sorted(tuple(r) for r in got) == [("d", 2018, 4, 4, 1), ("d", 2019, 2, 5, 3)]
