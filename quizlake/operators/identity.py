"""Row identities, winners among duplicates, numbering, papers and merging.  Every winner has a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, collapse, percent, strip, structural_threshold

#: How finished a paper is.
STATUS_RANK = {"publishable": 4, "publishable_with_hidden_rows": 3, "reupload_needed": 2, "draft": 1, "blocked": 0}
PUBLIC_STATUS = ("publishable", "publishable_with_hidden_rows")


def winners(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in the order, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def identity(df: DataFrame, scoped: bool = True, by_id: tuple[tuple[str, int], ...] = ()) -> Column:
    """A tagged key.  Scoped: paper, shift, exam, year and number, or paper, shift and id.  Else, or where these are missing:
    the id for exams and years in by_id, the id of rows with a paper or shift, exam, year and number, hash, id, the whole row.
    Only numbers above 0 count."""
    t = lambda c: strip(F.col(c).cast("string"))
    key = lambda kind, *p: F.struct(F.lit(kind).alias("kind"), F.concat_ws("\x1f", *p).alias("key"))
    name, has_id = collapse("exam_name"), ~blank("id")
    scope = F.concat_ws("::", F.when(blank("paper_id"), "NO_PAPER").otherwise(t("paper_id")), F.when(blank("shift_label"), "NO_SHIFT").otherwise(t("shift_label")))
    numbered = (name != "") & F.col("exam_year").isNotNull() & (F.coalesce("question_number", F.lit(0)) > 0)
    cases = [(numbered, key("paper", scope, name, t("exam_year"), t("question_number"))), (has_id, key("paper-id", scope, t("id")))] if scoped else []
    own = reduce(lambda a, x: a | ((name == x[0]) & (F.col("exam_year") == x[1])), by_id, F.lit(False))
    cases += [(own & has_id, key("row", t("id"))), ((~blank("shift_label") | ~blank("paper_id")) & has_id, key("id", t("id"))), (numbered, key("exam", name, t("exam_year"), t("question_number")))]
    cases += [(~blank("question_hash"), key("hash", t("question_hash"))), (has_id, key("id", t("id")))]
    return reduce(lambda out, case: F.when(case[0], case[1]).otherwise(out), reversed(cases), key("fallback", F.to_json(F.struct(*df.columns))))


def newest_first() -> list[Column]:
    return [F.col("updated_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").asc()]


def merged(df: DataFrame, keys: list, order: list[Column], any_of: tuple[str, ...] = ()) -> DataFrame:
    """The first row of each key, its blanks filled from later duplicates; the columns in any_of are OR-ed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = [c for c in df.columns if c not in keys]
    text = {c for c, t in df.dtypes if t == "string"}
    fill = [F.max(F.coalesce(F.col(c), F.lit(False))).over(whole).alias(c) if c in any_of else F.first(F.when(~blank(c), F.col(c)) if c in text else F.col(c), ignorenulls=True).over(whole).alias(c) for c in names]
    return df.select(*keys, *fill, F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


def richer(value: str) -> Column:
    """Aggregate: the longest text, of equals the larger."""
    return F.max(F.struct(F.length(strip(value)).alias("n"), F.col(value).alias("v")))["v"]


def duplicates(df: DataFrame, keys: list) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_numbers(df: DataFrame, key: str, number: str, expected: DataFrame | None = None) -> DataFrame:
    """Numbers from 1 to the larger of those seen and expected (key, expected) that a key lacks."""
    seen = df.groupBy(key).agg(F.max(number).alias("top"), F.collect_set(number).alias("have"))
    if expected is not None:
        seen = seen.join(expected, key, "left").withColumn("top", F.greatest("top", "expected")).drop("expected")
    return seen.where("top >= 1").select(key, F.explode(F.array_except(F.sequence(F.lit(1).cast(df.schema[number].dataType), F.col("top")), "have")).alias(number))


def trailing_numbers(df: DataFrame, key: str, number: str, expected: int) -> DataFrame:
    top = df.groupBy(key).agg(F.max(number).cast("int").alias("top")).where(F.col("top") < expected)
    return top.select(key, F.explode(F.sequence(F.col("top") + 1, F.lit(expected))).alias(number))


def numbering_reasons(df: DataFrame, key: str, number: str) -> DataFrame:
    """Per exam, if at least max(5, 80 % cut to a whole number) of its rows are numbered: what is wrong with the numbers."""
    rows = df.groupBy(key).agg(F.count("*").alias("rows"), F.count(number).alias("numbered"), F.countDistinct(number).alias("distinct"), F.max(number).alias("top"))
    judged = F.col("numbered") >= F.greatest(F.lit(5), F.floor(F.col("rows") * 0.8))
    reasons = F.array_sort(F.array_compact(F.array(F.when(F.col("numbered") < F.col("rows"), "unnumbered-questions"), F.when(F.col("distinct") < F.col("numbered"), "duplicate-question-numbers"), F.when(F.col("distinct") < F.col("top"), "missing-question-numbers"))))
    return rows.select(key, "rows", "numbered", F.when(judged, F.array_join(reasons, ",")).otherwise("").alias("reasons"))


def break_count(df: DataFrame, key: str, number: str, position: str) -> DataFrame:
    """How often a number is not above the one before."""
    w = Window.partitionBy(key).orderBy(position)
    return df.withColumn("_back", (F.lag(number).over(w) >= F.col(number)).cast("int")).groupBy(key).agg(F.coalesce(F.sum("_back"), F.lit(0)).alias("breaks"))


def carried_forward(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    return df.withColumn(value, F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(position)))


def spans(df: DataFrame, key: str, by: list[str], position: str) -> DataFrame:
    """First position of each group and the one before the next group's first; the last ends where the key ends."""
    first = df.groupBy(key, *by).agg(F.min(position).alias("start"))
    total = df.groupBy(key).agg(F.max(position).alias("_end"))
    return first.join(total, key).withColumn("stop", F.coalesce(F.lead("start").over(Window.partitionBy(key).orderBy("start", *by)) - 1, F.col("_end"))).drop("_end")


def propagate_images(df: DataFrame, key: str, number: str, image: str, reach: int = 10) -> DataFrame:
    """An image covers the next numbers in a row, up to `reach`, until a gap or another image."""
    w = Window.partitionBy(key).orderBy(number)
    gap = F.when(F.lag(number).over(w) == F.col(number) - 1, 0).otherwise(1)
    rows = df.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(w)).withColumn("_at", F.when(F.col(image).isNotNull(), F.struct(F.col(number).alias("n"), F.col(image).alias("i"))))
    run = Window.partitionBy(key, "_run").orderBy(number)
    rows = rows.withColumn("_last", F.last("_at", ignorenulls=True).over(run))
    return rows.withColumn(image, F.when(F.col(number) - F.col("_last.n") <= reach, F.col("_last.i"))).drop("_gap", "_run", "_at", "_last")


# Fixed values.
DATA_PARENT = r"(?i)\[(BAR GRAPH|PIE CHART|LINE GRAPH|TABLE|DIAGRAM|FIGURE|HISTOGRAM)\]"
DATA_REFERENCE = r"(?iUd)\b(the above|the following|given|based on|refer(?:ring)? to|according to|from the)\b.{0,40}(chart|graph|table|diagram|data|figure|passage)"


def data_images(rows: DataFrame, key: list[str], reach: int = 10) -> DataFrame:
    """rows with the image of a data question put on those that speak of it (J19): the next numbers in a row, `reach` at most, up to a gap
    or another question with an image.  Numbers are meant to be different within a key; rows without one stay as they are."""
    text, has = F.coalesce("question_text", F.lit("")), F.coalesce("has_image", F.lit(False))
    numbered = rows.where("question_number > 0")
    w = Window.partitionBy(*key).orderBy("question_number")
    parent = (F.coalesce("image_url", F.lit("")) != "") & text.rlike(DATA_PARENT)
    out = numbered.withColumn("_gap", F.when(F.lag("question_number").over(w) == F.col("question_number") - 1, 0).otherwise(1)).withColumn("_run", F.sum("_gap").over(w))
    # the last one with an image before, whatever it is, in the same run of numbers
    before = F.last(F.when(has, F.struct(F.col("question_number").alias("n"), parent.alias("is"), F.col("image_url").alias("url"))), ignorenulls=True).over(Window.partitionBy(*key, "_run").orderBy("question_number").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("_b", before)
    takes = ~has & F.coalesce(F.col("_b.is"), F.lit(False)) & (F.col("question_number") - F.col("_b.n") <= reach) & text.rlike(DATA_REFERENCE)
    out = out.withColumns({"image_url": F.when(takes, F.col("_b.url")).otherwise(F.col("image_url")), "has_image": has | takes}).select(*rows.columns)
    return out.unionByName(rows.where("question_number IS NULL OR question_number <= 0").withColumn("has_image", has).select(*rows.columns))


def latest_paper(papers: DataFrame, keys: list[str]) -> DataFrame:
    """Of public papers with questions that are not archived: the one with most visible, then most questions, the best status,
    the last version, the last id."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    live = ~F.coalesce(F.col("lifecycle"), F.lit("")).isin("archived") & F.col("status").isin(*PUBLIC_STATUS) & (n("total") > 0) & ((n("visible") > 0) | (n("hidden") > 0))
    papers = papers.where(live)
    rank = reduce(lambda out, x: F.when(F.col("status") == x[0], F.lit(x[1])).otherwise(out), STATUS_RANK.items(), F.lit(0))
    return winners(papers, keys, [F.desc("visible"), F.desc("total"), rank.desc(), F.desc("version"), F.desc("id")])


def next_version(papers: DataFrame, keys: list[str]) -> DataFrame:
    return papers.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def repoint(children: DataFrame, papers: DataFrame, keys: list[str], order: list) -> DataFrame:
    """children.paper_id moved from duplicate papers to the one that is kept."""
    kept = F.first("id").over(Window.partitionBy(*keys).orderBy(*order))
    moves = papers.select(F.col("id").alias("_from"), kept.alias("_to"))
    return children.join(moves, F.col("paper_id") == F.col("_from"), "left").withColumn("paper_id", F.coalesce("_to", "paper_id")).drop("_from", "_to")


def publish_state(rows: DataFrame) -> DataFrame:
    """Per paper counts and status; rows (paper_id, visible, structural boolean)."""
    out = rows.groupBy("paper_id").agg(F.count("*").alias("total"), F.sum(F.col("visible").cast("int")).alias("shown"), F.sum((~F.col("visible")).cast("int")).alias("hidden"), F.sum(F.col("structural").cast("int")).alias("structural"))
    out = out.withColumn("threshold", structural_threshold("total"))
    status = F.when((F.col("total") == 0) | (F.col("shown") == 0), "blocked").when(F.col("structural") >= F.col("threshold"), "reupload_needed").when(F.col("structural") > 0, "publishable_with_hidden_rows").otherwise("publishable")
    return out.withColumn("status", status).withColumn("lifecycle", F.when(F.col("total") > 0, "ingested").otherwise("processing"))


def coverage(rows: DataFrame, key: list[str], present: Column) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("total"), F.sum(present.cast("int")).alias("present")).withColumn("coverage", percent("present", "total"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column], protected: Column | None = None) -> DataFrame:
    """old with the rows of new put in; of new rows with one key the first in order wins; protected old rows stay as they are."""
    fresh = winners(new, keys, order)
    if protected is not None:
        fresh = fresh.join(old.where(protected).select(*keys), keys, "left_anti")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def changes(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: added, removed, changed or same for each key."""
    a, b = before.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ia")), after.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_ib"))
    kind = F.when(F.col("_ia").isNull(), "added").when(F.col("_ib").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, kind.alias("change"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of an ordered result: the rows after offset; the sort stops at offset + limit."""
    return df.orderBy(*order).offset(max(0, offset)).limit(limit)


def prefer_hits(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Rows with a hit, or all rows of a key where none has one."""
    return df.withColumn("_hit", hit).withColumn("_any", F.max("_hit").over(Window.partitionBy(*keys))).where("_hit OR NOT _any").drop("_hit", "_any")
