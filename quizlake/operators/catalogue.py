"""The public read path over question rows: visibility, papers, facets, identities, order, pages, catalogue and feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, collapse, exam_type, first_token, percent_half_up, strip
from ..sources.versions import written
from .identity import identity, merged, winners

LAST = 10**9
ANSWERS = ("correct_answer", "correct_answers", "answer_status")
#: The fields that a search reads.
SEARCHED = ("question", "subject", "topic", "subtopic", "concept", "type")
DIFFICULTIES = ("Easy", "Medium", "Hard")


def supported(df: DataFrame, names: list[str], always: str = "id") -> DataFrame:
    """The named columns that df has; `always` is among them."""
    return df.select(*(c for c in dict.fromkeys([always, *names]) if c in df.columns))


def without_answers(df: DataFrame) -> DataFrame:
    return df.drop(*ANSWERS)


def active() -> Column:
    """A row without the flag is active."""
    return F.coalesce("is_active", F.lit(True))


def practice_mode(df: DataFrame) -> bool:
    """Whether any row is ready for practice; one row decides."""
    return "practice_ready" in df.columns and not df.where("practice_ready").limit(1).isEmpty()


def is_public(df: DataFrame, include_all: bool = False, practice: bool = False) -> Column:
    """All active rows; else no row with a hidden structure, and in practice mode only those ready for it."""
    if include_all:
        return active()
    shown = F.coalesce(F.col("public_visibility") != "hidden_structural", F.lit(True)) if "public_visibility" in df.columns else F.lit(True)
    if practice:
        return shown & F.coalesce("practice_ready", F.lit(False))
    return shown & (active() if "is_active" in df.columns else F.lit(True))


def broken() -> Column:
    return F.coalesce(F.col("structural_status") == "broken", F.lit(False)) | F.coalesce(F.col("public_visibility") == "hidden_structural", F.lit(False))


def visible() -> Column:
    """The stored visibility, or where there is none, active and not broken."""
    return F.when(F.col("public_visibility").isNotNull(), F.col("public_visibility") == "visible").otherwise(~broken() & active())


def practice_candidate() -> Column:
    return active() & F.coalesce(F.col("public_visibility") != "hidden_structural", F.lit(True)) & (F.length(strip("question_text")) >= 3)


def in_papers(df: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows of the listed papers (id), and rows without a paper."""
    ids = papers.select(F.col("id").cast("string").alias("_paper")).distinct()
    hit = df.join(ids.withColumn("_hit", F.lit(True)), strip("paper_id") == F.col("_paper"), "left")
    return hit.where(F.col("_hit") | blank("paper_id")).drop("_paper", "_hit")


def public_papers(papers: DataFrame, statuses: tuple[str, ...] = ("publishable", "publishable_with_hidden_rows")) -> DataFrame:
    return papers.where(F.col("publish_status").isin(*statuses) & ~F.coalesce("lifecycle_status", F.lit("")).isin("replaced", "archived"))


def without_legacy(df: DataFrame, papers: DataFrame) -> DataFrame:
    """Without the rows that have no paper though their exam and year have one."""
    keys = papers.select(F.col("exam_name").alias("_e"), F.col("exam_year").alias("_y")).distinct().withColumn("_live", F.lit(True))
    hit = df.join(keys, (F.col("exam_name") == F.col("_e")) & (F.col("exam_year") == F.col("_y")), "left")
    return hit.where(~blank("paper_id") | F.col("_live").isNull()).drop("_e", "_y", "_live")


def facets(df: DataFrame, **equal) -> DataFrame:
    """Equality on each facet that is given; the filters reach the scan."""
    return reduce(lambda out, x: out.where(F.col(x[0]) == F.lit(x[1])), ((k, v) for k, v in equal.items() if v not in (None, "")), df)


def searched(df: DataFrame, needle: str | None, fields: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Rows whose fields, joined by blanks, hold the needle in either case; an empty needle finds all."""
    needle = (needle or "").strip().lower()
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in fields)))
    return df.where(text.contains(needle)) if needle else df


def safe_number(x) -> Column:
    """A number or text of digits as a number; anything else comes last."""
    text = strip(F.col(x).cast("string") if isinstance(x, str) else x)
    return F.coalesce(F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long")), F.lit(LAST))


def exam_order() -> list[Column]:
    number = F.when(F.coalesce("question_number", F.lit(0)) == 0, F.lit(LAST)).otherwise(F.col("question_number"))
    return [collapse("exam_name").asc(), F.coalesce("exam_year", F.lit(0)).desc(), number.asc(), F.col("id").asc()]


def topic_order() -> list[Column]:
    return [F.coalesce("exam_year", F.lit(0)).desc(), F.coalesce("exam_name", F.lit("")).asc(), safe_number("question_number").asc(), F.col("id").asc()]


def newest() -> list[Column]:
    return [F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").asc()]


def natural(x) -> Column:
    """A sort key in which runs of digits count as numbers and case doesn't."""
    parts = F.regexp_extract_all(F.lower(F.coalesce(F.col(x), F.lit(""))), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def listed(x, order: list[str]) -> Column:
    """The place in a list, and after it whatever the list lacks."""
    place = F.array_position(F.array(*(F.lit(v) for v in order)), F.col(x))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def cursor(x) -> Column:
    """A cursor as an offset: 0 for anything that is no number above 0."""
    return F.greatest(F.lit(0), F.coalesce(F.when(strip(x).rlike("^[+-]?[0-9]+$"), strip(x).try_cast("long")), F.lit(0)))


def unique_rows(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The first row of each public identity, its blanks filled from later ones; a row under review makes all of them so."""
    rows = df.withColumn("_key", F.to_json(identity(df)))
    any_of = tuple(c for c in ("needs_review", "has_image") if c in df.columns)
    return merged(rows, ["_key"], order or newest(), any_of).drop("_key")


def first_rows(df: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The first row of each public identity as it is."""
    return winners(df.withColumn("_key", F.to_json(identity(df))), ["_key"], order or newest()).drop("_key")


def public_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of deduplicated rows with the total, whether more follow and the next cursor.  rows are written once, so that
    what made them doesn't run for the page and the total each."""
    rows = written(rows, "page")
    total = rows.groupBy().agg(F.count("*").alias("total")).scalar()
    end = F.least(F.lit(offset + limit).cast("long"), F.col("total"))
    page = rows.orderBy(*order).offset(max(0, offset)).limit(limit).withColumn("total", total)
    return page.withColumn("has_more", end < F.col("total")).withColumn("next_cursor", F.when(F.col("has_more"), end.cast("string")))


def sampled(df: DataFrame, count: int, seed: int, **equal) -> DataFrame:
    """`count` rows drawn among those with the given facets: those of the least MD5 of seed and id, whatever the partitions are."""
    return facets(df, **equal).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), "id").limit(count)


def practice_key() -> Column:
    name, shift = collapse("exam_name"), strip("shift_label")
    numbered = (name != "") & (F.coalesce("exam_year", F.lit(0)) > 0) & (F.coalesce("question_number", F.lit(0)) > 0)
    key = lambda *parts: F.concat_ws("\x1f", *parts)
    exam = (name, F.col("exam_year").cast("string"))
    number = F.col("question_number").cast("string")
    return F.when(numbered & (shift != ""), key(F.lit("exam_shift"), *exam, shift, number)).when(numbered, key(F.lit("exam"), *exam, number)).when(~blank("question_hash"), key(F.lit("hash"), strip("question_hash"))).otherwise(key(F.lit("id"), strip("id")))


def practice_ready(rows: DataFrame, live: DataFrame) -> DataFrame:
    """id, target for each row: whether it is its identity's choice within exam and year (the live paper's, then one with a
    paper, then the newest, then the least id).  live (exam_name, exam_year, paper_id): one paper for each exam and year."""
    chosen = live.select(F.col("exam_name").alias("_e"), F.col("exam_year").alias("_y"), F.col("paper_id").alias("_paper"))
    name = collapse("exam_name")
    out = rows.join(chosen, (name == F.col("_e")) & (F.col("exam_year") == F.col("_y")), "left")
    ours = F.coalesce(F.col("paper_id") == F.col("_paper"), F.lit(False))
    order = [ours.desc(), F.col("paper_id").isNotNull().desc(), F.col("created_at").desc_nulls_last(), F.col("id").asc()]
    candidate = practice_candidate()
    place = F.row_number().over(Window.partitionBy(name, "exam_year", practice_key(), candidate).orderBy(*order))
    return out.select("id", F.coalesce("practice_ready", F.lit(False)).alias("was"), (candidate & (place == 1)).alias("target"))


def admin_rows(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """One row for each number within a paper or shift of an exam and year: the latest paper's, then a valid, then a visible
    one, then the newest, then the largest id; rows without a number stay.  latest (exam_name, exam_year, paper_id)."""
    chosen = latest.select(F.col("exam_name").alias("_e"), F.col("exam_year").alias("_y"), F.col("paper_id").alias("_paper"))
    out = rows.join(chosen, (collapse("exam_name") == F.col("_e")) & (F.col("exam_year") == F.col("_y")), "left")
    scope = F.when(~blank("paper_id"), strip("paper_id")).otherwise(strip("shift_label"))
    key = F.when(F.coalesce("question_number", F.lit(0)) > 0, F.concat_ws("\x1f", F.lit("qnum"), scope, F.col("question_number").cast("string"))).otherwise(F.concat_ws("\x1f", F.lit("id"), F.col("id").cast("string")))
    order = [F.coalesce(F.col("paper_id") == F.col("_paper"), F.lit(False)).desc(), F.coalesce(F.col("structural_status") == "broken", F.lit(False)).asc(), F.coalesce(F.col("public_visibility") == "visible", F.lit(False)).desc(), F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    return winners(out.withColumn("_key", key), ["exam_name", "exam_year", "_key"], order).drop("_key", "_e", "_y", "_paper")


def capped_ids(x, most: int = 50) -> Column:
    """The first `most` different ids of a list, in order."""
    return F.slice(F.array_distinct(x), 1, most)


def catalog(rows: DataFrame) -> DataFrame:
    """Per commission and exam type: questions, years (latest first), questions by year and by difficulty, and the name first
    seen (least id).  Rows without a name or a year are left out."""
    name = strip("exam_name")
    rows = rows.where((name != "") & (F.coalesce("exam_year", F.lit(0)) != 0)).withColumns({"commission": first_token("exam_name"), "exam_type": exam_type("exam_name"), "_name": name})
    by_year = rows.groupBy("commission", "exam_type", "exam_year").agg(F.count("*").alias("n"), F.min(F.struct("id", "_name")).alias("first"), *(F.count_if(F.col("difficulty") == d).alias(d) for d in DIFFICULTIES))
    years = F.reverse(F.array_sort(F.collect_list(F.struct("exam_year", "n"))))  # one entry for each year
    out = by_year.groupBy("commission", "exam_type").agg(F.sum("n").alias("count"), years.alias("years"), F.min("first")["_name"].alias("full_name"), *(F.sum(d).alias(d.lower()) for d in DIFFICULTIES))
    pairs = F.transform("years", lambda y: F.concat_ws(":", y["exam_year"].cast("string"), y["n"].cast("string")))
    return out.withColumn("year_counts", F.array_join(pairs, ",")).withColumn("years", F.array_join(F.transform("years", lambda y: y["exam_year"].cast("string")), ","))


def feed(rows: DataFrame) -> DataFrame:
    """Subject, topic and subtopic levels: questions, different years (a missing one is year 0), the latest year and its exam
    (of several the one of the largest id)."""
    rows = rows.withColumn("_year", F.coalesce("exam_year", F.lit(0)))
    latest = F.max(F.struct("_year", "id", F.coalesce("exam_name", F.lit("")).alias("exam")))
    levels = rows.rollup("subject", "topic", "subtopic").agg(F.grouping_id().alias("_g"), F.count("*").alias("count"), F.countDistinct("_year").alias("year_count"), latest.alias("_l"))
    return levels.where("_g < 7").select("subject", "topic", "subtopic", "count", "year_count", F.col("_l._year").alias("latest_year"), F.col("_l.exam").alias("latest_exam"))


def feed_exams(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.coalesce("exam_name", F.lit("")) != "").withColumn("_year", F.coalesce("exam_year", F.lit(0)))
    return rows.groupBy("exam_name").agg(F.count("*").alias("count"), F.countDistinct("_year").alias("year_count"), F.countDistinct("subject", "topic").alias("topic_count"))


def outline(rows: DataFrame) -> DataFrame:
    """Counts by subject, topic and, where there is one, subtopic of each exam and year; blank subjects and topics are General."""
    or_general = lambda c: F.when(blank(c), F.lit("General")).otherwise(strip(c))
    rows = rows.select("exam_name", "exam_year", or_general("subject").alias("subject"), or_general("topic").alias("topic"), F.when(~blank("subtopic"), strip("subtopic")).alias("subtopic"))
    exam = ["exam_name", "exam_year"]
    levels = [rows.groupBy(*exam, "subject"), rows.groupBy(*exam, "subject", "topic"), rows.where("subtopic IS NOT NULL").groupBy(*exam, "subject", "topic", "subtopic")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (x.agg(F.count("*").alias("count")) for x in levels))


def weightage(rows: DataFrame) -> DataFrame:
    """Whole percent of topics within subjects and subtopics within topics, beside subjects within all."""
    n = rows.groupBy("subject", "topic", "subtopic").agg(F.count("*").alias("n"))
    out = None
    for level in (["subject"], ["subject", "topic"], ["subject", "topic", "subtopic"]):
        x = n.groupBy(*level).agg(F.sum("n").alias("n"))
        parent = F.sum("n").over(Window.partitionBy(*level[:-1])) if level[:-1] else x.groupBy().agg(F.sum("n")).scalar()
        x = x.withColumn("_of", parent).withColumn("weight", percent_half_up("n", "_of")).drop("_of")
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def manifest(rows: DataFrame) -> DataFrame:
    """Papers and shifts of each exam and year: questions, first and last number.  Rows without a shift join the paper's only
    shift, where it has just one."""
    exam = ["exam_name", "exam_year"]
    rows = rows.select(*exam, F.when(~blank("paper_id"), strip("paper_id")).alias("paper_id"), F.when(~blank("shift_label"), strip("shift_label")).alias("shift_label"), "question_number")
    groups = rows.groupBy(*exam, "paper_id", "shift_label").agg(F.count("*").alias("n"), F.min("question_number").alias("first"), F.max("question_number").alias("last"))
    paper = Window.partitionBy(*exam, "paper_id")
    only = F.when(F.col("paper_id").isNotNull() & (F.count("shift_label").over(paper) == 1), F.max("shift_label").over(paper))
    groups = groups.withColumn("shift_label", F.coalesce("shift_label", only))
    return groups.groupBy(*exam, "paper_id", "shift_label").agg(F.sum("n").alias("question_count"), F.min("first").alias("first_question_number"), F.max("last").alias("last_question_number"))


def commission_totals(rows: DataFrame) -> DataFrame:
    """Per commission: questions, different exams, topics, years and papers."""
    rows = rows.where(~blank("exam_name")).withColumn("commission", first_token("exam_name"))
    return rows.groupBy("commission").agg(F.count("*").alias("questions"), F.countDistinct("exam_name").alias("exams"), F.countDistinct("topic").alias("topics"), F.countDistinct("exam_year").alias("years"), F.countDistinct("paper_id").alias("papers"))


def subject_counts(rows: DataFrame) -> DataFrame:
    return rows.where(active()).groupBy("subject").agg(F.count("*").alias("count"))


def stats(rows: DataFrame) -> DataFrame:
    """One row: active questions, three difficulties, years (latest first) and exams (by name)."""
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    rows = rows.where(active())
    # different names and years are few beside the rows; they are made distinct before they are put in one list
    years = rows.where("exam_year > 0").select("exam_year").distinct().groupBy().agg(text(F.reverse(F.array_sort(F.collect_list("exam_year"))))).scalar()
    exams = rows.where(~blank("exam_name")).select(collapse("exam_name").alias("e")).distinct().groupBy().agg(text(F.array_sort(F.collect_list("e")))).scalar()
    out = rows.groupBy().agg(F.count("*").alias("total"), *(F.count_if(F.col("difficulty") == d).alias(d.lower()) for d in DIFFICULTIES))
    return out.withColumn("years", years).withColumn("exams", exams)


def accessible(rows: DataFrame, free_papers: DataFrame, premium: bool) -> DataFrame:
    """All rows for a premium reader, else those of free papers."""
    return rows if premium else rows.join(free_papers.select("paper_id").distinct(), "paper_id", "left_semi")
