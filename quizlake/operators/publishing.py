"""Publish gate and repair queue of exams, and explanations that contradict the answer.

Rows are questions with exam_name and exam_year; every aggregate is by exam and year, windows hold one exam's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, filled, percent, regional_ratio, strip, structural_threshold
from ..sources.versions import written
from . import quality as Q
from .catalogue import active

EXAM = ["exam_name", "exam_year"]
#: The queue's order, the issues that count as structural, and the reasons behind a decision.
QUEUE_ORDER = ("numbering/data repair", "structural manual review", "image/manual review", "answer verification", "explanation regeneration")
STRUCTURAL_ISSUES = QUEUE_ORDER[:3]
STRUCTURAL_REASONS = ("missing-question-numbers", "duplicate-question-numbers", "unnumbered-questions", "invalid-match-payload", "incomplete-match-columns", "incomplete-match-stem", "regional-script", "short-or-empty-text", "no-active-questions")
ANSWER_REASONS = ("needs-review", "invalid-answer")
ASSERTED = r"(?iU)\b(?:option\s+)?{x}\s+is\s+(?:the\s+)?(?:correct|right|answer)\b|\bcorrect\s+answer\s+is\s+{x}\b|\banswer\s+is\s+{x}\b"
IMPLIED = r"(?iU)\b(?:correct answer|answer)\s*(?:is|:)\s*{x}\b"


def base_reasons() -> Column:
    """The sorted distinct reasons of a row: like the issue codes, without numbers and tags."""
    text = strip("question_text")
    options = F.filter(F.array(*(strip(o) for o in Q.OPTIONS)), lambda o: o != "")
    n, image, never = filled(*Q.OPTIONS), Q.image_dependent(), F.lit(False)
    inline = (n == 4) & (Q._count(text, Q.INLINE_OPTION) >= 2) & ~(Q._has(text, Q.STATEMENTS) & F.forall(options, lambda o: F.length(o) <= Q.LONGEST_OPTION))
    scripted = F.lower(F.coalesce("exam_name", F.lit(""))).rlike("|".join(Q.SCRIPTED_EXAMS))
    reasons = [
        F.when(F.length(text) < Q.LEAST_TEXT, "short-or-empty-text"),
        F.when(n < 4, F.when(image, "image-dependent-review").otherwise("incomplete-options")),
        F.when(Q._yes("needs_review"), "answer-review"),
        F.when(~Q._answer().isin(*Q.LETTERS), "invalid-answer"),
        F.when(inline | ((F.length(text) < 2) & (n < 2)), "broken-extraction"),
        F.when(~scripted & (regional_ratio(F.concat_ws(" ", text, F.array_join(options, " "))) >= Q.REGIONAL), "regional-script"),
        *Q._match_codes(text, options, never),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))


def numbering(rows: DataFrame) -> DataFrame:
    """Per exam and year: rows, numbered rows, the largest number, and whether numbers are meant to be there."""
    out = rows.groupBy(*EXAM).agg(F.count("*").alias("rows"), F.count("question_number").alias("numbered"), F.max("question_number").alias("top"))
    return out.withColumn("judged", F.col("numbered") >= F.greatest(F.lit(5), F.floor(F.col("rows") * 0.8)))


def gaps(rows: DataFrame) -> DataFrame:
    """The numbers from 1 to an exam's largest that it lacks, one gap between neighbours at a time."""
    seen = rows.where("question_number IS NOT NULL").select(*EXAM, "question_number").distinct()
    before = F.greatest(F.lit(0), F.coalesce(F.lag("question_number").over(Window.partitionBy(*EXAM).orderBy("question_number")), F.lit(0)))
    gap = seen.withColumn("_before", before).where(F.col("question_number") > F.col("_before") + 1)
    return gap.select(*EXAM, F.explode(F.sequence(F.col("_before") + 1, F.col("question_number") - 1)).alias("question_number"))


def repair_queue(rows: DataFrame, contradictions: DataFrame | None = None) -> DataFrame:
    """Rows with reasons, and a row without an id for each missing number (C8).  contradictions (question_id)."""
    rows = written(rows.select("id", *EXAM, "question_number", base_reasons().alias("_base")), "reasons")  # read four times below
    told = rows.join(numbering(rows), EXAM)
    if contradictions is not None:
        marks = contradictions.select(F.col("question_id").alias("id"), F.lit(True).alias("_contra")).distinct()
        told = told.join(marks, "id", "left")
    else:
        told = told.withColumn("_contra", F.lit(None).cast("boolean"))
    # rows without a number are no duplicates of each other; they are dealt out, since they may be many
    salt = F.when(F.col("question_number").isNull(), F.pmod(F.xxhash64("id"), F.lit(256)))
    twice = F.count("question_number").over(Window.partitionBy(*EXAM, "question_number", salt)) > 1
    more = F.array_compact(F.array(F.when(F.col("_contra"), "answer-explanation-contradiction"), F.when(F.col("judged") & F.col("question_number").isNull(), "unnumbered-questions"), F.when(F.col("question_number").isNotNull() & twice, "duplicate-question-numbers")))
    told = told.withColumn("reasons", F.array_sort(F.array_union("_base", more))).where(F.size("reasons") > 0).withColumn("c", Q.queue_class("reasons"))
    queue = told.select("id", *EXAM, "question_number", "c.issue", "c.severity", "c.blocker", "c.priority", "reasons")
    judged = numbering(rows).where("judged").select(*EXAM)
    missing = gaps(rows).join(judged, EXAM).select(F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), *EXAM, "question_number", F.lit(QUEUE_ORDER[0]).alias("issue"), F.lit("critical").alias("severity"), F.lit("none").alias("blocker"), F.lit("P0").alias("priority"), F.array(F.lit("missing-question-numbers")).alias("reasons"))
    return queue.unionByName(missing)


def queue_order() -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, QUEUE_ORDER)), F.col("issue"))
    return [place.asc(), F.col("question_number").asc_nulls_last(), F.coalesce(F.col("id").cast("string"), F.lit("")).asc()]


def assessed(rows: DataFrame, queue: DataFrame) -> DataFrame:
    """Per exam and year: what hides rows, what blocks the paper, whether it is to be uploaded anew."""
    blockers = queue.where("blocker = 'row'").groupBy(*EXAM).agg(F.count("*").alias("row_blockers"), F.count_if(F.col("issue").isin(*STRUCTURAL_ISSUES)).alias("structural"), F.count_distinct("id").alias("_hidden"))
    out = rows.groupBy(*EXAM).agg(F.count("*").alias("question_count")).join(blockers, EXAM, "left").na.fill(0, ["row_blockers", "structural", "_hidden"])
    out = out.withColumn("threshold", structural_threshold("question_count")).withColumn("reupload_needed", F.col("structural") >= F.col("threshold"))
    out = out.withColumn("paper_blockers", F.when(F.col("reupload_needed"), F.col("structural")).otherwise(0)).withColumn("publishable", F.col("paper_blockers") == 0)
    out = out.withColumn("with_hidden_rows", F.col("publishable") & (F.col("row_blockers") > 0)).withColumn("visible_count", F.col("question_count") - F.col("_hidden"))
    return out.drop("_hidden")


def gate(rows: DataFrame, papers: DataFrame | None = None, samples: int = 20) -> DataFrame:
    """A report for each exam and year with active rows, and for each latest paper without any."""
    rows = rows.where(active())
    queue = written(repair_queue(rows), "queue")
    hidden = queue.where("blocker IN ('row', 'paper')")
    reasons = hidden.groupBy(*EXAM).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))  # sets of a dozen labels
    place = F.row_number().over(Window.partitionBy(*EXAM).orderBy(*queue_order()))
    text = F.concat(F.lit("Q"), F.coalesce(F.col("question_number").cast("string"), F.lit("?")), F.lit(":"), F.col("issue"))
    first = hidden.withColumn("_n", place).where(F.col("_n") <= samples).groupBy(*EXAM).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("t")))), lambda x: x["t"]).alias("samples"))
    none = F.array().cast("array<string>")
    out = assessed(rows, queue).join(reasons, EXAM, "left").join(first, EXAM, "left")
    out = out.select(*EXAM, "question_count", "publishable", "with_hidden_rows", "reupload_needed", "visible_count", F.col("row_blockers").alias("hidden_count"), F.coalesce("reasons", none).alias("reasons"), F.coalesce("samples", none).alias("samples"))
    if papers is None:
        return out
    live = papers.where(~F.coalesce("lifecycle_status", F.lit("")).isin("replaced", "archived"))
    latest = live.withColumn("_n", F.row_number().over(Window.partitionBy(*EXAM).orderBy(F.desc("upload_version"), "id"))).where("_n = 1")
    lost = latest.join(out.select(*EXAM), EXAM, "left_anti")
    no = F.lit(False)
    lost = lost.select(*EXAM, F.coalesce("question_count", F.lit(0)).cast("long").alias("question_count"), no.alias("publishable"), no.alias("with_hidden_rows"), (F.col("publish_status") == "reupload_needed").alias("reupload_needed"), F.coalesce("visible_question_count", F.lit(0)).cast("long").alias("visible_count"), F.coalesce("hidden_question_count", F.lit(0)).cast("long").alias("hidden_count"), F.array(F.lit("no-active-questions")).alias("reasons"), none.alias("samples"))
    return out.unionByName(lost)


def readiness(reports: DataFrame) -> DataFrame:
    """One row of counts over the gate's reports."""
    return reports.groupBy().agg(F.count_if("publishable").alias("publishable_exams"), F.count_if(~F.col("publishable")).alias("blocked_exams"), F.count_if("with_hidden_rows").alias("with_hidden_rows"), F.count_if("reupload_needed").alias("reupload_needed_exams"))


def visible_ids(rows: DataFrame, queue: DataFrame) -> DataFrame:
    """Ids of the rows that nothing in the queue hides."""
    return rows.select("id").join(queue.where("blocker = 'row' AND id IS NOT NULL").select("id"), "id", "left_anti")


def exam_report(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    """Numbers, review, tags, explanations and queue of each exam and year."""
    queue = written(repair_queue(rows), "queue")
    told = rows.join(explanations.select(F.col("question_id").alias("id"), F.lit(1).alias("_told")).distinct(), "id", "left")
    n = lambda c: F.count_if(c)
    generic = lambda c, names: n(strip(c).isin(*names))
    counts = told.groupBy(*EXAM).agg(
        F.count("*").alias("rows"), F.count("question_number").alias("numbered"), F.coalesce(F.max("question_number"), F.lit(0)).alias("max_seen"), n(Q._yes("needs_review")).alias("needs_review"), n(~Q._answer().isin(*Q.LETTERS)).alias("invalid_answers"),
        generic("subject", ("General Knowledge", "Unclassified", "")).alias("generic_subjects"), generic("topic", ("General", "Unclassified", "")).alias("generic_topics"), n(strip("subtopic") == "").alias("empty_subtopics"), F.count("_told").alias("explained"),
    )
    missing = gaps(rows).groupBy(*EXAM).agg(F.count("*").alias("missing_numbers"))
    twice = rows.where("question_number IS NOT NULL").groupBy(*EXAM, "question_number").count().where("count > 1").groupBy(*EXAM).agg(F.count("*").alias("duplicate_numbers"))
    size = queue.groupBy(*EXAM).agg(F.count("*").alias("queue_rows"))
    out = counts.join(missing, EXAM, "left").join(twice, EXAM, "left").join(size, EXAM, "left").join(assessed(rows, queue).select(*EXAM, "row_blockers", "structural", "threshold"), EXAM)
    return out.na.fill(0, ["missing_numbers", "duplicate_numbers", "queue_rows"])


def decision(reasons, needs_review, image_reviews) -> Column:
    """What an exam's blockers are about (C9): reasons is an array, the others are counts of rows under review."""
    reasons = col(reasons)
    structural, answers = Q._any_of(reasons, STRUCTURAL_REASONS), Q._any_of(reasons, ANSWER_REASONS)
    images = answers & ~structural & (col(needs_review) > 0) & (col(needs_review) == col(image_reviews))
    return F.when(F.size(reasons) == 0, "publishable").when(images, "image-dependent").when(answers & ~structural, "answer-related").when(structural & ~answers, "extraction-structure-related").otherwise("mixed")


def implies_other(explanation, answer) -> Column:
    """Exactly one letter is named as the answer, and it is another one."""
    text, answer = strip(explanation), F.upper(strip(answer))
    named = F.filter(F.array(*(F.when(text.rlike(IMPLIED.format(x=x)), x) for x in Q.LETTERS)), lambda x: x.isNotNull())
    return answer.isin(*Q.LETTERS) & (F.size(named) == 1) & ~F.array_contains(named, answer)


def asserts_other(explanation, answer) -> Column:
    """Any letter but the answer's is asserted to be right."""
    text, answer = F.coalesce(col(explanation), F.lit("")), F.upper(strip(answer))
    hit = F.lit(False)
    for x in Q.LETTERS:
        hit = hit | ((answer != x) & text.rlike(ASSERTED.format(x=x)))
    return (text != "") & (F.coalesce(col(answer), F.lit("")) != "") & hit


def mismatches(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    """Questions whose explanation holds the text of exactly one option, and that is not the answer."""
    told = explanations.where(F.coalesce("explanation", F.lit("")) != "").groupBy("question_id").agg(F.max("explanation").alias("explanation"))
    rows = rows.where(active()).join(told, F.col("id") == F.col("question_id")).where(Q._answer().isin(*Q.LETTERS))
    low = F.lower("explanation")
    held = F.array_compact(F.array(*(F.when((F.length(strip(o)) >= 3) & low.contains(F.lower(strip(o))), x) for x, o in zip(Q.LETTERS, Q.OPTIONS, strict=True))))
    out = rows.withColumn("_held", held).where((F.size("_held") == 1) & (F.element_at("_held", 1) != Q._answer()))
    return out.select("question_id", *EXAM, "question_number", Q._answer().alias("correct_answer"), F.element_at("_held", 1).alias("explanation_implies"), F.substring("explanation", 1, 240).alias("explanation_excerpt"))


def answer_coverage(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    """Answers and explanations of each exam and year, by active rows."""
    verified = Q._answer().isin(*Q.LETTERS) & ~Q._yes("needs_review")
    told = explanations.select(F.col("question_id").alias("id"), F.lit(True).alias("_told")).distinct()
    rows = rows.where(F.col("is_active")).withColumn("_ok", verified).join(told, "id", "left")
    out = rows.groupBy("exam_name", F.coalesce("exam_year", F.lit(0)).alias("exam_year")).agg(F.count("*").alias("total_questions"), F.count_if("_ok").alias("verified_answers"), F.count_if(~F.col("_ok")).alias("missing_answers"), F.count_if(F.col("_ok") & F.col("_told")).alias("explanations_generated"))
    out = out.withColumn("answer_coverage_pct", percent("verified_answers", "total_questions")).withColumn("explanation_coverage_pct", percent("explanations_generated", "verified_answers"))
    return out.withColumn("has_answer_key", (F.col("missing_answers") == 0) | (F.col("verified_answers") > 0)).withColumn("needs_answer_key", F.col("verified_answers") == 0)
