"""Raw question blocks: the readiness audit, stabilisation by question number, drafts of the ready ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions.text import matched, strip

# Marks of solutions and formulas, reasons that alone withhold a block, limits of the points.
SOLUTION = r"(?i)\b(?:sol(?:ution)?|shortcut|alternate method|ratio method|atq)\b"
FORMULA = r"=|%|÷|/|\+|-|\b(?:ratio|method|profit|loss|discount)\b"
WITHHOLDING = ("implausible_question_number", "option_incomplete", "possible_merge", "very_low_extraction_confidence", "mixed_page_recovery_low_confidence", "strong_solution_leakage")
STATUS = {6: "withhold_for_now", 2: "needs_manual_review", 0: "ready_for_phase_c"}
LATE_PAGES = 50


def number(x: str = "question_number_raw") -> Column:
    """The question number if it is written in digits only, else null."""
    return F.when(F.col(x).rlike("^[0-9]+$"), F.col(x).try_cast("long"))


def options_written(x: str = "raw_options_text") -> Column:
    """Option letters at line starts, or different ones anywhere, whichever are more."""
    text = F.coalesce(F.col(x), F.lit(""))
    anywhere = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-D]\s*[).:-]"), F.lit(0)))
    return F.greatest(F.regexp_count(text, F.lit(r"(?m)^\s*[A-D]\s*[).:-]")), F.size(anywhere))


def points() -> list[tuple[str, Column, int]]:
    """(reason, condition, points) in their order.  Null numbers count as 0, null texts as empty."""
    at = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    text = strip("raw_block_text")
    letters, digits = matched(text, "[A-Za-z]"), matched(text, "[0-9]")
    options, isolated = F.greatest(options_written(), at("options_recovered_count").cast("int")), at("option_isolation_confidence")
    solved, formulas = F.regexp_count(text, F.lit(SOLUTION)), F.regexp_count(text, F.lit(FORMULA))
    lines, sure, mixed = at("line_count"), at("extraction_confidence"), at("mixed_block_confidence")
    on_mixed = F.coalesce(F.col("boundary_detection_note"), F.lit("")).contains("mixed_page")
    short = (letters < 18) & (digits < 4)
    return [
        ("implausible_question_number", ~F.coalesce(number().between(1, 9999), F.lit(False)), 3),
        ("question_text_incomplete", short, 3),
        ("question_text_short", ~short & (letters < 32), 1),
        ("partial_options", options.between(2, 3), 1),
        ("option_incomplete", options < 2, 3),
        ("option_isolation_low_confidence", isolated < 0.55, 2),
        ("option_isolation_partial", (isolated >= 0.55) & (isolated < 0.72), 1),
        ("possible_solution_leakage", solved >= 1, 2),
        ("strong_solution_leakage", (solved >= 2) | ((solved >= 1) & (formulas >= 3)), 2),
        ("possible_merge", F.coalesce(F.col("merged_question_risk"), F.lit(False)), 3),
        ("single_line_fragment", lines <= 1, 2),
        ("short_block_shape", lines == 2, 1),
        ("mixed_page_recovery_low_confidence", on_mixed & (mixed < 0.72), 3),
        ("mixed_page_recovery", on_mixed & (mixed >= 0.72), 1),
        ("very_low_extraction_confidence", sure < 0.68, 3),
        ("low_extraction_confidence", (sure >= 0.68) & (sure < 0.8), 1),
        ("mixed_page_recovery_risk", F.coalesce(F.col("source_page_type") == "mixed_special_page", F.lit(False)) & (mixed < 0.78), 2),
    ]


def audited(blocks: DataFrame) -> DataFrame:
    """blocks with failure_reasons, severity and status.  options_recovered_count and option_isolation_confidence come
    from the isolation of the options."""
    rules = points()
    reasons = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when, _ in rules)))
    severity = reduce(lambda a, b: a + b, (F.when(when, F.lit(n)).otherwise(F.lit(0)) for _, when, n in rules))
    out = blocks.withColumns({"failure_reasons": reasons, "severity": severity})
    withheld = F.arrays_overlap("failure_reasons", F.array(*map(F.lit, WITHHOLDING)))
    first, second, last = STATUS
    return out.withColumn("status", F.when(withheld | (F.col("severity") >= first), STATUS[first]).when(F.col("severity") >= second, STATUS[second]).otherwise(STATUS[last]))


def ready(blocks: DataFrame) -> DataFrame:
    """The audited blocks that may be drafted."""
    return blocks.where(F.col("status") == STATUS[0])


def stabilised(blocks: DataFrame, page: list[str], position: str, top: str = "y0") -> DataFrame:
    """blocks without those whose number lies below half the page's median (if that is over LATE_PAGES), with place: their order
    on the page from 0.  Numbers that go back, without repeats, put the page in order of number.  position is unique on a page.

    A page's rows are sorted by windows and spill like any sort; none is gathered into an array.
    """
    here, by_number = Window.partitionBy(*page), Window.partitionBy(*page).orderBy("_n", position)
    before = Window.partitionBy(*page).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.withColumn("_n", number()).withColumn("_rank", F.row_number().over(Window.partitionBy(*page).orderBy(F.col("_n").asc_nulls_last(), position)))
    out = out.withColumn("_count", F.count("_n").over(here))
    out = out.withColumn("_median", F.max(F.when(F.col("_rank") == F.floor(F.col("_count") / 2) + 1, F.col("_n"))).over(here))
    outlier = (F.col("_count") >= 2) & (F.col("_median") > LATE_PAGES) & (F.col("_n") < F.greatest(F.lit(1), F.floor(F.col("_median") / 2)))
    out = out.where(~F.coalesce(outlier, F.lit(False)))
    out = out.withColumns({"_back": F.col("_n") <= F.last("_n", ignorenulls=True).over(before), "_again": F.col("_n") == F.lag("_n").over(by_number)})
    moved = F.coalesce(F.max("_back").over(here), F.lit(False)) & ~F.coalesce(F.max("_again").over(here), F.lit(False))
    out = out.withColumn("_moved", moved)
    far = F.lit(10**9)
    keys = [F.when(F.col("_moved"), F.coalesce(c, far)) for c in ("_n", top)]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy(*keys, position)) - 1)
    return out.drop("_n", "_rank", "_count", "_median", "_back", "_again", "_moved")
