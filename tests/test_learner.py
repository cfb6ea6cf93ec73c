"""Learner analytics on rows written by hand, after the reference."""

from datetime import datetime, timedelta

from quizlake.operators import learner as L

START = datetime(2024, 1, 1)


def answered(uid, n, right, subjects=1, days=1):
    """n attempts, the first `right` of them right, dealt over subjects and days in turn."""
    return [(uid, f"S{i % subjects}", i < right, START + timedelta(days=i % days, seconds=i)) for i in range(n)]


def test_all_badges(spark):
    rows = answered("sharp", 20, 15) + answered("near", 200, 139) + answered("elite", 50, 43, 5, 7) + answered("xp", 500, 500, 1, 30) + answered("few", 9, 9, 5) + answered("third", 120, 120)
    rows += [("gap", "S0", None, START), ("gap", None, True, START + timedelta(days=2))]
    got = {r.uid: r.asDict() for r in L.all_badges(spark.createDataFrame(rows, "uid string, subject string, is_correct boolean, at timestamp")).collect()}
    earned = {uid: {k for k, v in r.items() if v is True} for uid, r in got.items()}
    assert earned["sharp"] == {"first10", "acc70"}  # 75 %, which 80 % would refuse
    assert earned["near"] == {"first10", "first100", "acc70", "level3"}  # 69.5 % is rounded up
    assert earned["elite"] == {"first10", "acc70", "acc85", "streak7", "subject_pro", "all_subjects"}  # 9 of 10 in S0
    assert earned["xp"] == {"first10", "first100", "first500", "streak7", "streak30", "acc70", "acc85", "subject_pro", "level3", "level5", "xp5000"}
    assert earned["few"] == {"all_subjects"}  # no subject has five
    assert earned["third"] == {"first10", "first100", "acc70", "acc85", "subject_pro", "level3"} and got["third"]["level"] == 3
    assert not earned["gap"] and got["gap"]["xp"] == 12 and got["gap"]["streak"] == 1


def test_weakness(spark):
    made = [(None, "T", "", "P", 1, True), ("", "T", "u", "", 1, False), ("S", "T", "v", None, 2, False), ("S", "T", None, None, 3, True), ("R", "T", None, None, None, True), (None, None, None, "P", 1, None)]
    rows = [("u", *r, i, START + timedelta(seconds=i)) for i, r in enumerate(made)]
    df = spark.createDataFrame(rows, "uid string, subject string, topic string, subtopic string, pattern_tag string, question_id long, is_correct boolean, attempt_id long, at timestamp")
    found = lambda out, *c: {tuple(r[x] for x in c) for r in out.collect()}
    assert found(L.weakness(df, "subject", 3), "subject", "total", "correct") == {("General", 3, 1)}
    assert found(L.topic_report(df), "place", "subject", "topic", "subtopic", "total", "accuracy") == {(1, "S", "T", "", 2, 50.0), (2, "General", "T", "u", 2, 50.0)}
    questions = spark.createDataFrame([(1, "Q"), (2, "P"), (3, "")], "id long, pattern_tag string")
    assert found(L.pattern_report(df, questions), "pattern_tag", "total", "correct") == {("P", 3, 1)}
