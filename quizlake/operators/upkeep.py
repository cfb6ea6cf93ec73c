"""Rules and jobs that keep the question store: what may be published or recovered, answer keys, papers, flags, merges.

A job returns the rows to write; the caller decides where.  Keys are equal on both sides unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, col, collapse, content_hash, filled, percent, percent_half_up, regional_ratio, strip
from . import quality as Q
from .catalogue import active
from .identity import winners

EXAM = ["exam_name", "exam_year"]
#: Fixed values.
FRAGMENT = r"(?iU)^(?:[A-D](?:\s*[,&]\s*[A-D])*(?:\s+(?:and|only|are correct|both|all))?|All\s+of\s+the\s+above|None\s+of\s+the\s+above|(?:Only\s+)?[1-4](?:\s+and\s+[1-4])?|Both\s+[A-D]\s+and\s+[A-D])\s*$"
CURRENT = ("current affairs", "current", "recent", "latest", "2024", "2025", "2026")
SECONDS_EACH = 72


# what a row is good for


def publish_block() -> Column:
    """Why a row must not be published, null if it may be: the first reason that holds."""
    text = strip("question_text")
    options = F.filter(F.array(*(strip(o) for o in Q.OPTIONS)), lambda o: o != "")
    n = F.size(options)
    fallback = Q._yes("has_image") & (F.coalesce("image_url", F.lit("")) != "") & (n == 4)
    scripted = F.lower(F.coalesce("exam_name", F.lit(""))).rlike("|".join(Q.SCRIPTED_EXAMS))
    regional = ~scripted & (regional_ratio(F.concat_ws(" ", text, F.array_join(options, " "))) >= Q.REGIONAL)
    match = F.coalesce(*Q._match_codes(text, options, F.lit(False)))
    combo = (F.length(text) < 20) & (n == 4) & F.forall(options, lambda o: o.rlike(Q.MATCH_CODE))
    kept = F.lit(None).cast("string")
    soft = lambda reason: F.when(~fallback, reason).otherwise(kept)  # noqa: E731  a picture stands for the text
    return F.when(F.coalesce("question_number", F.lit(0)) <= 0, "unnumbered-questions").when(regional, soft(F.lit("regional-script"))).when(match.isNotNull(), soft(match)).when(combo, soft(F.lit("option-combo-fragment")))


def recoverable() -> Column:
    """A row counts as recovered: enough text, four options, no regional script, and a match question with two columns."""
    text = strip("question_text")
    match = (F.lower(strip("question_type")) == "match") | F.lower(text).contains("match the following") | (F.instr(text, Q.MATCH_MARK) > 0)
    payload = F.from_json(F.substring(text, F.instr(text, Q.MATCH_MARK) + len(Q.MATCH_MARK), F.length(text)), "col1 array<string>, col2 array<string>")
    size = lambda c: F.size(F.filter(F.coalesce(payload[c], F.array().cast("array<string>")), lambda x: ~blank(x)))
    columns = (F.instr(text, Q.MATCH_MARK) > 0) & (size("col1") >= 2) & (size("col2") >= 2)
    whole = F.concat_ws(" ", text, *(strip(o) for o in Q.OPTIONS))
    return (F.length(text) >= 15) & (regional_ratio(whole) < Q.REGIONAL) & (filled(*Q.OPTIONS) == 4) & (~match | columns)


def answer_fragment(text) -> Column:
    """A stem that is only an answer."""
    return strip(text).rlike(FRAGMENT)


def low_quality() -> Column:
    """An extracted row that deserves another try."""
    text, kind = F.coalesce("question_text", F.lit("")), F.coalesce("question_type", F.lit("mcq"))
    payload = F.from_json(F.substring(text, F.instr(text, Q.MATCH_MARK) + len(Q.MATCH_MARK), F.length(text)), "col1 array<string>, col2 array<string>")
    empty = (F.coalesce(F.size(payload["col1"]), F.lit(0)) <= 0) | (F.coalesce(F.size(payload["col2"]), F.lit(0)) <= 0)
    cancelled = Q._yes("is_cancelled")
    return ((kind == "mcq") & (filled(*Q.OPTIONS) < 2) & ~cancelled) | (~(Q._yes("has_image") | text.startswith("[")) & (F.length(text) < 40) & ~cancelled) | ((kind == "match") & ((F.instr(text, Q.MATCH_MARK) == 0) | empty))


def scrambled(text) -> Column:
    """A text layer of at least 100 characters that is no text."""
    x = F.coalesce(col(text), F.lit(""))
    control = F.length(x) - F.length(F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    return (F.length(x) >= 100) & (F.lower(x).contains("(cid:") | (control > 0.1 * F.length(x)) | F.lower(x).rlike("[bcdfghjklmnpqrstvwxyz]{15,}"))


def truncated(current, cached) -> Column:
    """A text that looks like a cut form of a longer one: inside it, inside it without blanks, or with the same beginning."""
    a, b = F.lower(collapse(current)), F.lower(collapse(cached))
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    head = F.least(F.length(a), F.length(b), F.lit(80))
    inside = F.contains(b, a) | (F.contains(tight(b), tight(a)) & (F.length(tight(b)) > F.length(tight(a)) + 40))
    begun = (head >= 30) & (F.substring(a, F.lit(1), head) == F.substring(b, F.lit(1), head)) & (F.length(b) > F.length(a) + 40)
    return (a != "") & (b != "") & (a != b) & (F.length(b) >= F.length(a) + 30) & (inside | begun)


def without_options(text, *options) -> Column:
    """The stem before the first line that is an option line and repeats one of the options."""
    tidy = lambda x: F.lower(collapse(x))
    lines = F.split(F.coalesce(col(text), F.lit("")), "\n")
    known = F.filter(F.array(*(tidy(o) for o in options)), lambda o: o != "")
    form = r"(?U)^\s*(?:\(?[A-Da-d1-4][).]|\([A-Da-d1-4]\))\s*(.+)$"
    hit = F.array_position(F.transform(lines, lambda line: line.rlike(form) & F.array_contains(known, tidy(F.regexp_extract(line, form, 1)))), F.lit(True))
    return F.when(hit > 1, strip(F.array_join(F.slice(lines, F.lit(1), (hit - 1).cast("int")), "\n"))).otherwise(F.coalesce(col(text), F.lit("")))


def json_list(raw) -> Column:
    """The JSON array in a model's answer, as text: without fences, whole, in the first list of an object, or cut out; null if none."""
    x = strip(F.regexp_replace(F.coalesce(col(raw), F.lit("")), "```(?:json)?", ""))
    cut = F.regexp_extract(x, r"(?s)(\[.*\])", 1)
    parse = lambda v: F.try_parse_json(F.nullif(v, F.lit("")))
    is_list = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    members = F.map_values(F.try_variant_get(parse(x), "$", "map<string,variant>"))
    first = F.try_element_at(F.filter(members, is_list), F.lit(1))
    return F.when(is_list(parse(x)), F.to_json(parse(x))).when(first.isNotNull(), F.to_json(first)).when(is_list(parse(cut)), F.to_json(parse(cut)))


def exam_seconds(questions) -> Column:
    return col(questions) * SECONDS_EACH


# batches


def numbered_only(rows: DataFrame, key: list[str] = EXAM) -> DataFrame:
    """Without the unnumbered rows of papers that are mostly numbered: 80 %, or half with 50 numbers and one from 50 on."""
    w = Window.partitionBy(*key)
    has = F.coalesce("question_number", F.lit(0)) > 0
    n, total = F.count_if(has).over(w), F.count("*").over(w)
    most = (n >= 0.8 * total) | ((n >= 50) & (F.max("question_number").over(w) >= 50) & (n >= 0.5 * total))
    return rows.withColumn("_drop", most & ~has).where("NOT _drop").drop("_drop")


def hashed(rows: DataFrame, place: str = "position") -> DataFrame:
    """rows with question_hash; of equal hashes the last stays."""
    out = rows.withColumn("question_hash", content_hash("exam_name", "exam_year", "question_number", "question_text", *Q.OPTIONS))
    return winners(out, ["question_hash"], [F.desc(place)])


def upsert_actions(new: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """new with action insert, update, locked or rehashed (D11): an active, reviewed row of the same exam is locked; a hash that
    another exam holds is made anew from the text."""
    old = stored.select("question_hash", strip("exam_name").alias("_e"), F.coalesce("exam_year", F.lit(0)).alias("_y"), F.coalesce(~F.col("needs_review") & F.col("is_active"), F.lit(False)).alias("_done"))
    old = old.groupBy("question_hash", "_e", "_y").agg(F.bool_or("_done").alias("_done"))
    hits = new.join(old, "question_hash", "left")
    same = (F.col("_e") == strip("exam_name")) & (F.col("_y") == F.coalesce("exam_year", F.lit(0)))
    told = hits.groupBy(*new.columns).agg(F.bool_or(F.coalesce(~same, F.lit(False))).alias("_other"), F.bool_or(F.coalesce(same, F.lit(False))).alias("_same"), F.bool_or(F.coalesce(same & F.col("_done"), F.lit(False))).alias("_locked"))
    action = F.when(F.col("_locked") & F.lit(not force), "locked").when(F.col("_other"), "rehashed").when(F.col("_same"), "update").otherwise("insert")
    scoped = content_hash("exam_name", "exam_year", F.lit(None).cast("int"), "question_text", *Q.OPTIONS)
    return told.withColumn("action", action).withColumn("question_hash", F.when(F.col("action") == "rehashed", scoped).otherwise(F.col("question_hash"))).drop("_other", "_same", "_locked")


def activated(rows: DataFrame, run: DataFrame) -> DataFrame:
    """rows with is_active set where an inactive row of an exam of the run is fit to be shown: reviewed, its state derived, enough
    text, four options, one answer, nothing that blocks it (the last step of E6).  run: exam_name, exam_year, whatever else."""
    due = run.select(*EXAM).distinct().withColumn("_due", F.lit(True))
    fit = ~Q._yes("needs_review") & F.col("structural_status").isNotNull() & (F.length(strip("question_text")) >= 15) & (filled(*Q.OPTIONS) == 4) & F.upper(strip("correct_answer")).isin(*Q.LETTERS) & publish_block().isNull()
    old = rows.alias("o").join(F.broadcast(due).alias("d"), F.expr(" AND ".join(f"o.{c} <=> d.{c}" for c in EXAM)), "left").select("o.*", "_due")
    now = F.col("is_active") | F.coalesce(F.col("_due") & (F.col("is_active") == F.lit(False)) & fit, F.lit(False))
    return old.withColumn("is_active", now).drop("_due")


def stored(new: DataFrame, old: DataFrame, force: bool = False) -> DataFrame:
    """The table after a run (E6): rows of new hashed, those that may not be shown left inactive, put in by their action, and what is
    fit in the run's exams activated.  new and old have the same columns, question_hash among them."""
    told = upsert_actions(hashed(new).select(*old.columns), old, force).where("action <> 'locked'")
    told = told.withColumn("is_active", F.coalesce(F.col("is_active"), F.lit(True)) & publish_block().isNull()).select(*old.columns)
    kept = old.join(told.select(*EXAM, "question_hash"), [*EXAM, "question_hash"], "left_anti")
    return activated(kept.select(*old.columns).unionByName(told), new)


def filled_from(rows: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Blank options filled from a second extraction of the same number, short stems of MCQ replaced; what is still incomplete
    needs review (N1, J16)."""
    two = second.select(*key, *(F.col(c).alias(f"_{c}") for c in ("question_text", *Q.OPTIONS)), F.lit(True).alias("_there"))
    out = rows.join(two, key, "left")
    hit = F.coalesce("_there", F.lit(False))
    values = {o: F.when(hit & blank(o), strip(f"_{o}")).otherwise(F.col(o)) for o in Q.OPTIONS}
    values["question_text"] = F.when(hit & (F.col("question_type") == "MCQ") & (F.coalesce("_question_text", F.lit("")) != "") & (F.length(strip("question_text")) < 20), F.col("_question_text")).otherwise(F.col("question_text"))
    out = out.withColumns(values)
    return out.withColumn("needs_review", Q._yes("needs_review") | (hit & (filled(*Q.OPTIONS) < 4))).select(*rows.columns)


def drafts(numbers: DataFrame, stored: DataFrame) -> DataFrame:
    """Inactive rows for the numbers (exam_name, exam_year, question_number) that have no row at all."""
    lost = numbers.distinct().join(stored.select(*EXAM, "question_number"), [*EXAM, "question_number"], "left_anti")
    text = F.concat(F.lit("[Manual repair required for Question #"), F.col("question_number"), F.lit(". Automatic extraction could not recover this row from the latest upload.]"))
    key = F.concat_ws("_", F.lit("manual_repair"), F.lower(strip("exam_name")), F.col("exam_year").cast("string"), F.col("question_number").cast("string"))
    return lost.select(*EXAM, "question_number", text.alias("question_text"), *(F.lit("").alias(o) for o in Q.OPTIONS), F.lit("A").alias("correct_answer"), F.lit(False).alias("is_active"), F.lit(True).alias("needs_review"), key.alias("question_hash"))


def key_injected(rows: DataFrame, key: DataFrame, joint: str = "/") -> DataFrame:
    """rows with the answers of a key (exam_name, exam_year, question_number, answer): X deletes a question, several letters
    accept each, one letter verifies; `changed` marks those whose explanations are stale (E8, J15)."""
    one = key.groupBy(*EXAM, "question_number").agg(F.max(F.upper(strip("answer"))).alias("_key"))
    out = rows.join(one, [*EXAM, "question_number"], "left")
    letters = F.filter(F.split("_key", joint), lambda x: x.isin(*Q.LETTERS))
    gone, many, single = F.col("_key") == "X", F.size(letters) >= 2, F.col("_key").isin(*Q.LETTERS)
    hit = F.coalesce(gone | many | single, F.lit(False))
    changed = F.coalesce(gone | many | (single & (F.upper(F.coalesce("correct_answer", F.lit(""))) != F.col("_key"))), F.lit(False))
    return out.select(
        *(c for c in rows.columns if c not in ("correct_answer", "correct_answers", "answer_status", "needs_review")),
        F.when(many, F.element_at(letters, 1)).when(single, F.col("_key")).otherwise(F.col("correct_answer")).alias("correct_answer"), F.when(many, letters).alias("correct_answers"),
        F.when(gone, "deleted").when(many, "multiple").when(single, "verified").otherwise(F.col("answer_status")).alias("answer_status"), (Q._yes("needs_review") & ~hit).alias("needs_review"), changed.alias("changed"),
    )


def promotable(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """Rows under review with a letter as answer that come from a computer-based test, and what says so."""
    kinds = papers.select(F.col("id").alias("paper_id"), F.lower(strip("extractor_type")).alias("_kind"))
    name = F.lower(strip("exam_name"))
    marked = F.contains(name, F.lit("cbt")) | F.contains(F.concat(F.lit(" "), name, F.lit(" ")), F.lit(" shift "))
    source = F.when(F.col("_kind") == "cbt", "extractor_type=cbt").when(~blank("shift_label"), "shift_label").when(marked, "exam_name_marker")
    out = rows.where(Q._yes("needs_review") & Q._answer().isin(*Q.LETTERS)).join(kinds, "paper_id", "left").withColumn("source", source)
    return out.where("source IS NOT NULL").drop("_kind")


def attached(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """paper_id filled from the newest paper of the same exam and year where it is missing."""
    latest = winners(papers, EXAM, [F.desc("upload_version"), F.desc("id")]).select(*EXAM, F.col("id").alias("_paper"))
    return rows.join(latest, EXAM, "left").withColumn("paper_id", F.when(blank("paper_id"), F.col("_paper")).otherwise(F.col("paper_id"))).drop("_paper")


def new_versions(papers: DataFrame, uploads: DataFrame) -> DataFrame:
    """papers with each upload (id, exam_name, exam_year) as a next version, in order of their ids; each version is replaced by the one
    after it (E3, W8)."""
    latest = winners(papers, EXAM, [F.desc("upload_version"), F.desc("id")]).select(*EXAM, F.col("id").alias("_old"), F.col("upload_version").alias("_v"))
    turn = Window.partitionBy(*EXAM).orderBy("id")
    numbered = uploads.select("id", *EXAM, F.row_number().over(turn).alias("_n"), F.lag("id").over(turn).alias("_before"), F.lead("id").over(turn).alias("_after")).join(latest, EXAM, "left")
    made = numbered.select("id", *EXAM, (F.coalesce("_v", F.lit(0)) + F.col("_n")).cast("int").alias("upload_version"), F.when(F.col("_after").isNull(), "processing").otherwise("replaced").alias("lifecycle_status"), F.coalesce("_before", "_old").alias("supersedes"))
    over = numbered.where("_n = 1 AND _old IS NOT NULL").select(F.col("_old").alias("_was"), F.lit(True).alias("_gone"))  # one row a paper
    old = papers.join(over, F.col("id") == F.col("_was"), "left").withColumn("lifecycle_status", F.when(F.col("_gone"), "replaced").otherwise(F.col("lifecycle_status")))
    return old.select("id", *EXAM, "upload_version", "lifecycle_status", F.lit(None).cast(dict(papers.dtypes)["id"]).alias("supersedes")).unionByName(made)


def toggles(selected: DataFrame, stored: DataFrame) -> DataFrame:
    """id, change: what must be enabled and what disabled so that the selection is what is active."""
    on = selected.select("id").distinct().join(stored.where("is_active").select("id"), "id", "left_anti").withColumn("change", F.lit("enable"))
    return on.unionByName(stored.where("is_active").select("id").distinct().join(selected.select("id"), "id", "left_anti").withColumn("change", F.lit("disable")))


def renamed(rows: DataFrame, old: str, new: str, column: str = "exam_name") -> DataFrame:
    """The same rename on each frame that carries the name."""
    return rows.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def soft_deleted(rows: DataFrame, doomed: Column) -> DataFrame:
    """Rows of a predicate set inactive; a hard delete is a filter."""
    return rows.withColumn("is_active", F.when(F.coalesce(doomed, F.lit(False)), F.lit(False)).otherwise(F.col("is_active")))


def cascaded(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """children without those of deleted parents."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def failed_jobs(jobs: DataFrame, as_of, minutes: int = 0) -> DataFrame:
    """Jobs that still run at a restart fail."""
    stuck = F.col("status").isin("processing", "queued") & (F.col("at") <= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))
    return jobs.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def replaced(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """All rows of the keys in new replaced by those of new."""
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def revealed(rows: DataFrame, ids: DataFrame, most: int = 300) -> DataFrame:
    """Answers of the public rows asked for; a request names at most `most` ids, in its order."""
    asked = winners(ids, ["id"], ["place"]).orderBy("place").limit(most)
    return rows.where(active()).join(F.broadcast(asked.select("id")), "id", "left_semi").select("id", "correct_answer")


def flagged(flags: DataFrame, questions: DataFrame, least: int = 1) -> DataFrame:
    """Flags per question with its text, for those with enough of them."""
    n = flags.groupBy("question_id").agg(F.count("*").alias("flags"), F.max("at").alias("latest")).where(F.col("flags") >= least)
    return n.join(questions, F.col("question_id") == F.col("id")).drop("id")


def resolved(flags: DataFrame, done: DataFrame) -> DataFrame:
    """Flags that are left, counted anew, after those of resolved questions are dismissed."""
    left = flags.join(done.select("question_id"), "question_id", "left_anti")
    return flags.select("question_id").distinct().join(left.groupBy("question_id").agg(F.count("*").alias("flags")), "question_id", "left").na.fill(0, ["flags"])


def _containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """_i, _o for the names of inner (_y, _i, _low) and outer (_y, _o, _low) of a year of which the first lies in the second.  Names are
    joined on the first three characters of the inner and all runs of three of the outer one; shorter names by the year alone."""
    o = outer.select(F.col("_y"), F.col("_o"), F.col("_low").alias("_in"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_in") - 2), lambda k: F.substring("_in", k, F.lit(3))))
    long = inner.where(F.length("_low") >= 3).withColumn("_key", F.substring("_low", 1, 3)).join(o.where(F.length("_in") >= 3).select("*", F.explode(runs).alias("_key")), ["_y", "_key"])
    short = inner.where(F.length("_low") < 3).join(o, "_y")
    return long.select("_y", "_i", "_o", "_low", "_in").unionByName(short.select("_y", "_i", "_o", "_low", "_in")).where(F.contains("_in", F.col("_low"))).select("_y", "_i", "_o")


def resolved_name(names: DataFrame, papers: DataFrame) -> DataFrame:
    """asked -> the stored name of the same year: the equal one, else one that holds it or is held by it, with most visible,
    then most questions, the last version, the least name (J17).  Different names, not papers, are compared."""
    known = papers.where(~F.coalesce("lifecycle_status", F.lit("")).isin("archived", "replaced")).groupBy(collapse("exam_name").alias("_name"), F.col("exam_year").alias("_y"))
    known = known.agg(F.max(F.struct(F.coalesce("visible", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("t"), F.coalesce("upload_version", F.lit(0)).alias("u"))).alias("_rank"))
    named = names.distinct().withColumn("_a", F.lower(collapse("asked")))
    left, right = named.select(F.col("exam_year").alias("_y"), F.col("asked").alias("_i"), F.col("_a").alias("_low")), known.select("_y", F.col("_name").alias("_o"), F.lower("_name").alias("_low"))
    swapped = _containing(right.withColumnRenamed("_o", "_i"), left.withColumnRenamed("_i", "_o")).select("_y", F.col("_o").alias("_i"), F.col("_i").alias("_o"))
    pairs = _containing(left, right).unionByName(swapped).distinct().join(known.withColumnRenamed("_name", "_o"), ["_y", "_o"])
    hits = named.join(pairs, (F.col("exam_year") == F.col("_y")) & (F.col("asked") == F.col("_i")), "left").withColumnRenamed("_o", "_name")
    best = winners(hits, ["asked", "exam_year"], [(F.col("_a") == F.lower("_name")).desc_nulls_last(), F.col("_rank").desc_nulls_last(), F.col("_name").asc()])
    return best.select("asked", "exam_year", F.coalesce("_name", collapse("asked")).alias("exam_name"))


# reports


def missing_public(rows: DataFrame) -> DataFrame:
    """Per exam and year: active, inactive, usable though inactive, broken, usable though not visible."""
    usable = (F.length(strip("question_text")) >= 15) & (filled(*Q.OPTIONS) >= 2)
    on, n = F.coalesce("is_active", F.lit(False)), F.count_if
    hidden = F.coalesce("public_visibility", F.lit("")) != "visible"
    return rows.groupBy(F.coalesce("exam_name", F.lit("")).alias("exam_name"), F.coalesce("exam_year", F.lit(0)).alias("exam_year")).agg(F.count("*").alias("total"), n(on).alias("active"), n(~on).alias("inactive"), n(~on & usable).alias("inactive_usable"), n(F.coalesce(F.col("structural_status") == "broken", F.lit(False))).alias("broken"), n(hidden & usable).alias("hidden_visible_text"))


def exam_analytics(rows: DataFrame) -> DataFrame:
    """One row: difficulties (unknown ones are Medium) and current against static questions, with whole percents."""
    kind = F.when(F.col("difficulty").isin("Easy", "Hard"), F.col("difficulty")).otherwise("Medium")
    text = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("undefined")) for c in ("subject", "topic", "question"))))
    current = reduce(lambda a, k: a | text.contains(k), CURRENT, F.lit(False))
    out = rows.groupBy().agg(F.count("*").alias("total"), *(F.count_if(kind == d).alias(d.lower()) for d in ("Easy", "Medium", "Hard")), F.count_if(current).alias("current"))
    out = out.withColumn("static", F.col("total") - F.col("current"))
    return out.withColumns({f"{c}_percent": percent_half_up(c, "total") for c in ("easy", "medium", "hard", "current", "static")})


def cost_log(runs: DataFrame) -> DataFrame:
    """Runs with their cost and the total of all that were not cached."""
    total = runs.where(~Q._yes("cached")).groupBy().agg(F.coalesce(F.sum("cost"), F.lit(0.0))).scalar()
    return runs.withColumn("total_cost", total)


def parse_quality(rows: DataFrame, good: Column, key: list[str]) -> DataFrame:
    """Share of good rows."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows"), F.avg(good.cast("double")).alias("quality"))


def keyword_accuracy(subjects: DataFrame, buckets: dict[str, list[str]]) -> DataFrame:
    """Accuracy of each user over subjects that name a keyword, per bucket; without answers there is no row."""
    out = None
    for name, words in buckets.items():
        hit = reduce(lambda a, w: a | F.lower("subject").contains(w), words, F.lit(False))
        x = subjects.where(hit).groupBy("uid").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).where("total > 0").withColumn("bucket", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out.withColumn("accuracy", percent_half_up("correct", "total"))


def session_stats(answers: DataFrame, key: list[str]) -> DataFrame:
    """Practice session: right, wrong, answered, accuracy, points; ignored answers and gaps don't count."""
    live = F.col("correct").isNotNull() & ~Q._yes("ignored")
    out = answers.groupBy(*key).agg(F.count_if(live & F.col("correct")).alias("right"), F.count_if(live & ~F.col("correct")).alias("wrong"))
    out = out.withColumn("answered", F.col("right") + F.col("wrong"))
    return out.withColumn("accuracy", percent_half_up("right", "answered")).withColumn("xp", F.col("right") * 10 + F.col("wrong") * 2)


def due_reviews(schedule: DataFrame, questions: DataFrame, as_of, limit: int = 20) -> DataFrame:
    """Each user's first `limit` cards that are due, with their questions, in order of the due date."""
    w = Window.partitionBy("uid").orderBy("due_date", "question_id")
    due = schedule.where(F.col("due_date") <= F.lit(as_of).cast("date")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    return due.join(questions, F.col("question_id") == F.col("id")).drop("id")


def coverage_of(rows: DataFrame, explanations: DataFrame, eligible: Column) -> DataFrame:
    """Explained rows among all and among the eligible ones, with percents (A10)."""
    told = explanations.select(F.col("question_id").alias("id"), F.lit(True).alias("_told")).distinct()
    rows = rows.join(told, "id", "left").withColumns({"_e": F.coalesce(eligible, F.lit(False)), "_told": F.coalesce("_told", F.lit(False))})
    out = rows.groupBy().agg(F.count("*").alias("total"), F.count_if("_told").alias("explained"), F.count_if("_e").alias("eligible"), F.count_if(F.col("_e") & F.col("_told")).alias("eligible_explained"))
    return out.withColumn("coverage", percent("explained", "total")).withColumn("eligible_coverage", percent("eligible_explained", "eligible"))
