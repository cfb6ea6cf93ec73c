"""Learner analytics over an attempt log: uid, exam, subject, topic, is_correct, seconds, at, attempt_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, commission, level, percent, percent_half_up
from ..sources.versions import written

REWARD = {"right": 10, "wrong": 2}
LATEST = (F.desc, "at", "attempt_id")


def newest(by="uid"):
    return Window.partitionBy(by).orderBy(F.desc("at"), F.desc("attempt_id"))


def oldest(by="uid"):
    return Window.partitionBy(by).orderBy("at", "attempt_id")


def rights() -> Column:
    return F.sum(F.col("is_correct").cast("int"))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with 1..n in a total order, without one task that holds all rows; ties get a rank of their own each, in any order.

    Rows are dealt by range and written once, each with the number of its range; they are numbered within it, and the rows of the
    ranges before are added.  The number is stored with the row, so however the plans above coalesce or re-run, counts and
    rows speak of the same ranges."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return own.join(F.broadcast(counts), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_part", "_own", "_before")


def leaderboard(attempts: DataFrame, since: Column | None = None) -> DataFrame:
    """Score, accuracy, favourite exam (ties: the larger name) and rank 1..n per user; blank users are left out, the rank goes
    by the exact ratio."""
    rows = (attempts if since is None else attempts.where(F.col("at") >= since)).where(~blank("uid"))
    by_exam = rows.groupBy("uid", "exam").agg(F.count("*").alias("n"), rights().alias("right"), F.max("at").alias("at"))
    users = by_exam.groupBy("uid").agg(F.sum("n").alias("attempted"), F.sum("right").alias("correct"), F.max(F.struct("n", "exam"))["exam"].alias("top_exam"), F.max("at").alias("latest"))
    users = users.withColumn("score", F.col("correct") * REWARD["right"] + (F.col("attempted") - F.col("correct")) * REWARD["wrong"]).withColumn("accuracy", percent("correct", "attempted", 0))
    users = users.withColumn("_ratio", F.col("correct") / F.col("attempted"))
    return ranked(users, [F.desc("score"), F.desc("_ratio"), F.desc("attempted"), F.desc("latest"), F.asc("uid")]).drop("_ratio")


def with_commission(board: DataFrame, special=(), known=()) -> DataFrame:
    return board.withColumn("top_commission", commission("top_exam", special, known))


def by_subject(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("uid", "subject").agg(rights().alias("correct"), F.sum((~F.col("is_correct")).cast("int")).alias("incorrect"), F.count("*").alias("total")).withColumn("xp", F.col("correct") * 10 + F.col("incorrect") * 2)


def daily_activity(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("uid", F.to_date("at").alias("day")).agg(F.count("*").alias("n"))


def recent(attempts: DataFrame, n: int = 20) -> DataFrame:
    return attempts.withColumn("position", F.row_number().over(newest())).where(F.col("position") <= n)


def or_general(key: str) -> Column:
    """A null or empty subject or topic counts as General."""
    x = F.col(key).cast("string")
    return F.when(x.isNull() | (x == ""), F.lit("General")).otherwise(x)


def _accuracies(rows: DataFrame, keys: list[str], least: int, *more: Column) -> DataFrame:
    right = F.sum(F.coalesce(F.col("is_correct"), F.lit(False)).cast("int"))
    return rows.groupBy("uid", *keys).agg(F.count("*").alias("total"), right.alias("correct"), *more).where(F.col("total") >= least).withColumn("accuracy", percent("correct", "total"))


def weakness(attempts: DataFrame, key: str, least: int, last: int = 500, top: int | None = None) -> DataFrame:
    """Accuracy by key over each user's last attempts, weakest first; keys with fewer than `least` attempts are left out."""
    out = _accuracies(recent(attempts, last).withColumn(key, or_general(key)), [key], least)
    if top is None:
        return out
    return out.withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy("accuracy", F.desc("total"), key))).where(F.col("place") <= top)


def topic_report(attempts: DataFrame, least: int = 2, last: int = 500, top: int = 10) -> DataFrame:
    """The weakest (subject, topic) of each user with the newest attempt's subtopic; of equals the one attempted last goes first."""
    rows = recent(attempts, last).withColumns({"subject": or_general("subject"), "topic": or_general("topic")})
    newest_of = F.min(F.struct("position", F.coalesce("subtopic", F.lit("")).alias("subtopic"))).alias("_newest")
    out = _accuracies(rows, ["subject", "topic"], least, newest_of).withColumn("subtopic", F.col("_newest.subtopic"))
    place = F.row_number().over(Window.partitionBy("uid").orderBy("accuracy", "_newest.position"))
    return out.withColumn("place", place).where(F.col("place") <= top).drop("_newest")


def pattern_report(attempts: DataFrame, questions: DataFrame, least: int = 2, last: int = 500) -> DataFrame:
    """Accuracy by pattern; an attempt without a tag takes that of its question, questions (id, pattern_tag), and without either doesn't count."""
    rows = with_pattern_tags(recent(attempts, last), questions)
    return _accuracies(rows.where("pattern_tag IS NOT NULL"), ["pattern_tag"], least)


def with_pattern_tags(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """attempts with pattern_tag taken from their question where they have none (J2); of questions that repeat an id the larger tag."""
    tags = questions.where("id IS NOT NULL").groupBy(F.col("id").alias("question_id")).agg(F.max("pattern_tag").alias("_tag"))
    return attempts.join(tags, "question_id", "left").withColumn("pattern_tag", F.coalesce(F.nullif("pattern_tag", F.lit("")), F.nullif("_tag", F.lit("")))).drop("_tag")


def streak_by_day(attempts: DataFrame) -> DataFrame:
    """uid, day, streak: after each day with attempts, how many days in a row end with it."""
    days = attempts.select("uid", F.to_date("at").alias("day")).distinct()
    w = Window.partitionBy("uid").orderBy("day")
    runs = days.withColumn("_island", F.date_sub("day", F.row_number().over(w)))
    return runs.select("uid", "day", F.row_number().over(Window.partitionBy("uid", "_island").orderBy("day")).alias("streak"))


def strongest_gap(attempts: DataFrame, benchmark: int = 70, least: int = 5) -> DataFrame:
    """Whole percent (half up) of subjects with enough attempts, and how far that is above the benchmark."""
    out = attempts.groupBy("uid", "subject").agg(F.count("*").alias("total"), rights().alias("correct")).where(F.col("total") >= least)
    out = out.withColumn("accuracy", percent_half_up("correct", "total")).withColumn("gap", F.col("accuracy") - benchmark)
    return out.withColumn("share", percent("total", F.sum("total").over(Window.partitionBy("uid"))))


def rolling_accuracy(attempts: DataFrame, n: int = 5) -> DataFrame:
    return attempts.withColumn("rolling", F.avg(F.col("is_correct").cast("double") * 100).over(oldest().rowsBetween(1 - n, 0)))


def streak(attempts: DataFrame, as_of) -> DataFrame:
    """Days in a row that end at as_of, 0 without activity on that day."""
    days = attempts.select("uid", F.to_date("at").alias("day")).distinct()
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("uid").orderBy("day")))).groupBy("uid", "island").agg(F.max("day").alias("last"), F.count("*").alias("n"))
    return runs.groupBy("uid").agg(F.coalesce(F.max(F.when(F.col("last") == F.lit(as_of).cast("date"), F.col("n"))), F.lit(0)).alias("streak"), F.max("n").alias("longest"))


def pace(attempts: DataFrame, fast: int = 30, steady: int = 60) -> DataFrame:
    """Attempts by pace; an attempt without a time took no time."""
    seconds = F.coalesce("seconds", F.lit(0))
    kind = F.when(seconds <= fast, "Fast").when(seconds <= steady, "Balanced").otherwise("Slow")
    return attempts.groupBy("uid", kind.alias("pace")).agg(F.count("*").alias("n"), rights().alias("correct"))


def review_times(attempts: DataFrame, last: int = 20) -> DataFrame:
    """Counts, accuracy and times over the last attempts; only times above 0 count, 0 stands for none."""
    t = F.when(F.col("seconds") > 0, F.col("seconds"))
    right = F.sum(F.coalesce(F.col("is_correct"), F.lit(False)).cast("int"))
    out = recent(attempts, last).groupBy("uid").agg(F.count("*").alias("total"), right.alias("correct"), F.coalesce(F.floor(F.avg(t) + 0.5), F.lit(0)).alias("mean_s"), F.coalesce(F.min(t), F.lit(0)).alias("least_s"), F.coalesce(F.max(t), F.lit(0)).alias("most_s"))
    return out.withColumn("wrong", F.col("total") - F.col("correct")).withColumn("accuracy", percent_half_up("correct", "total"))


def mistakes(attempts: DataFrame, key: str, top: int = 5) -> DataFrame:
    out = attempts.where(~F.col("is_correct")).groupBy("uid", key).agg(F.count("*").alias("n"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("n"), key))).where(F.col("place") <= top)


def week_dots(attempts: DataFrame, as_of) -> DataFrame:
    """The seven days up to as_of for each user, with what was done on them."""
    end = F.lit(as_of).cast("date")
    users = attempts.select("uid").distinct().withColumn("day", F.explode(F.sequence(F.date_sub(end, 6), end)))
    return users.join(daily_activity(attempts), ["uid", "day"], "left").select("uid", "day", F.coalesce("n", F.lit(0)).alias("n"))


def last_seen(attempts: DataFrame, key: str) -> DataFrame:
    return attempts.withColumn("position", F.row_number().over(newest())).groupBy("uid", key).agg(F.min("position").alias("last_seen"))


def all_badges(attempts: DataFrame) -> DataFrame:
    """The twelve badges of a user; the streak is the run of days that ends on the last active one, and a null subject is one of its own."""
    rounded = F.floor(F.col("correct") / F.col("total") * 100 + 0.5)
    subjects = attempts.groupBy("uid", "subject").agg(F.count("*").alias("total"), F.sum(F.coalesce(F.col("is_correct"), F.lit(False)).cast("int")).alias("correct")).withColumn("accuracy", rounded)
    users = subjects.groupBy("uid").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.count("*").alias("subjects"), F.coalesce(F.max(F.when(F.col("total") >= 5, F.col("accuracy"))), F.lit(0)).alias("best"))
    days = attempts.select("uid", F.to_date("at").alias("day")).distinct()
    runs = days.withColumn("island", F.date_sub("day", F.row_number().over(Window.partitionBy("uid").orderBy("day")))).groupBy("uid", "island").agg(F.max("day").alias("last"), F.count("*").alias("n"))
    users = users.join(runs.groupBy("uid").agg(F.max_by("n", "last").alias("streak")), "uid", "left")
    users = users.withColumn("accuracy", rounded).withColumn("xp", F.col("correct") * 10 + (F.col("total") - F.col("correct")) * 2).withColumn("level", level("xp"))
    n, accuracy, at_level = F.col("total"), F.col("accuracy"), F.col("level")
    earned = {
        "first10": n >= 10, "first100": n >= 100, "first500": n >= 500, "streak7": F.col("streak") >= 7, "streak30": F.col("streak") >= 30,
        "acc70": (accuracy >= 70) & (n >= 20), "acc85": (accuracy >= 85) & (n >= 50), "subject_pro": F.col("best") >= 90,
        "level3": at_level >= 3, "level5": at_level >= 5, "xp5000": F.col("xp") >= 5000, "all_subjects": F.col("subjects") >= 5,
    }
    return users.select("uid", "xp", "level", "streak", *(c.alias(name) for name, c in earned.items()))


def mock_result(questions: DataFrame, answers: DataFrame, by: tuple[str, ...] = ("subject",)) -> DataFrame:
    """Right, wrong and skipped by subject (or subject and topic), without deleted questions; accuracy is of those answered,
    score of all.  questions (question_id, subject, accepted, deleted), answers (question_id, selected)."""
    rows = questions.where(~F.coalesce("deleted", F.lit(False))).join(answers, "question_id", "left")
    given = F.coalesce("selected", F.lit("")) != ""
    right = given & F.coalesce(F.array_contains("accepted", F.col("selected")), F.lit(False))
    out = rows.groupBy(*by).agg(F.count_if(right).alias("correct"), F.count_if(given & ~right).alias("wrong"), F.count_if(~given).alias("skipped"), F.count("*").alias("total"))
    return out.withColumn("accuracy", percent_half_up("correct", F.col("correct") + F.col("wrong"))).withColumn("score", percent_half_up("correct", "total"))


def sm2(state: Column, quality: Column) -> Column:
    """One step of spaced repetition: state (interval_days, ease, repetitions) after a review of quality 0 to 5.  A failed one
    costs 0.2 of the ease; a passed one's interval grows by the new ease before it is rounded."""
    miss = 5 - quality
    grown = F.greatest(F.lit(1.3), state["ease"] + (0.1 - miss * (0.08 + miss * 0.02)))
    passed = quality >= 3
    ease = F.when(passed, F.bround(grown, 3)).otherwise(F.greatest(F.lit(1.3), state["ease"] - 0.2))
    interval = F.when(~passed, 1).when(state["repetitions"] == 0, 1).when(state["repetitions"] == 1, 6).otherwise(F.bround(state["interval_days"] * grown).cast("int"))
    return F.struct(interval.cast("int").alias("interval_days"), ease.alias("ease"), F.when(passed, state["repetitions"] + 1).otherwise(0).cast("int").alias("repetitions"))


def schedule(reviews: DataFrame) -> DataFrame:
    """Folds each card's reviews (uid, question_id, quality, at) in order; the due date follows the last one."""
    start = F.struct(F.lit(1).alias("interval_days"), F.lit(2.5).cast("double").alias("ease"), F.lit(0).alias("repetitions"))
    folded = reviews.groupBy("uid", "question_id").agg(F.array_sort(F.collect_list(F.struct("at", "quality"))).alias("r"))
    out = folded.withColumn("s", F.aggregate("r", start, lambda s, x: sm2(s, x["quality"])))
    return out.select("uid", "question_id", "s.*", F.date_add(F.to_date(F.element_at("r", -1)["at"]), F.col("s.interval_days")).alias("due_date"))
