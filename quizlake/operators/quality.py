"""Row quality: issue codes, the state derived from them, repairs, queue classes and extraction scores.

Every rule is a column over one row, so a whole question bank is judged in one scan without a shuffle.  A row needs
the columns of QUESTION; others stay untouched.  Nulls count as empty text and as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, col, filled, matched, regional_ratio, strip, strip_regional

# Labels, weights, limits and patterns that decide results.
STRUCTURAL = ("short-or-empty-text", "incomplete-options", "image-dependent-review", "broken-extraction", "regional-script", "invalid-match-payload", "incomplete-match-columns", "incomplete-match-stem", "unnumbered-questions")
ANSWER = ("invalid-answer", "answer-option-missing")
TAGGING = ("generic-subject-tag", "generic-topic-tag", "missing-subtopic-tag")
PENALTY = {"short-or-empty-text": 35, "incomplete-options": 35, "image-dependent-review": 18, "broken-extraction": 30, "regional-script": 20, "invalid-match-payload": 30, "incomplete-match-columns": 25, "incomplete-match-stem": 20, "unnumbered-questions": 15, "invalid-answer": 30, "answer-option-missing": 25, "answer-explanation-contradiction": 30, "generic-subject-tag": 8, "generic-topic-tag": 6, "missing-subtopic-tag": 3, "answer-review": 8}
STALE_PENALTY, LEAST_TEXT, REGIONAL, LONGEST_OPTION, LEAST_STEM = 12, 15, 0.12, 120, 24
LETTERS = ("A", "B", "C", "D")
SCRIPTED_EXAMS = ("upsc", "cisf", "nda", "cds")
NO_SUBJECT, NO_TOPIC = ("", "general knowledge", "unclassified"), ("", "general", "unclassified")
MATCH_MARK = "__MATCH__:"
IMAGE = r"(?i)\b(?:bar\s+graph|pie\s+chart|bar\s+chart|line\s+graph|histogram|(?:the\s+)?(?:graph|chart|figure|diagram|picture|map)\s+(?:below|above|given|shown|following)|(?:following|given|below)\s+(?:graph|chart|figure|diagram|table|map)|refer\s+to\s+the|data\s+given\s+(?:below|above)|study\s+the\s+(?:following\s+)?(?:graph|chart|figure|table|diagram)|from\s+the\s+(?:graph|chart|figure|table)|dice|venn\s+diagram)\b"
INLINE_OPTION = r"(?i)(?:^|\s)[A-D][).]\s+"
STATEMENTS = r"(?i)(?:which\s+of\s+the\s+following\s+statements|read\s+the\s+statements|arrange\s+the\s+following|which\s+of\s+the\s+above|select\s+the\s+correct\s+option|select\s+the\s+correct\s+pair|chronological\s+order|jumbled\s+order|meaningful\s+sentences|synonyms?|antonyms?|statements?\s+\d)"
MATCH_CODE = r"(?i)^\s*(?:\d+\s*[-–]\s*[A-D](?:\s*,\s*\d+\s*[-–]\s*[A-D]){1,7}|[A-D]\s*[-–]\s*\d+(?:\s*,\s*[A-D]\s*[-–]\s*\d+){1,7})\s*$"
MATCH_PARTS = r"(?i)\b(?:column|list\s+i|list\s+ii|a\.|b\.|c\.|d\.|1\.|2\.|3\.|4\.)"
INSTRUCTION = r"(?i)\b(?:hall\s+ticket|admission\s+certificate|invigilator|answer\s+sheet|omr|general\s+instructions|read\s+carefully|candidate\s+should|candidates?\s+(?:are|must|should|will)|do\s+not\s+(?:open|write|fold|start|mark)|write\s+your\s+(?:name|roll\s+number|registration\s+number)|maximum\s+marks?|time\s+allowed|rough\s+work|mobile\s+phones?|electronic\s+gadgets?|question\s+booklet|booklet\s+series|seal\s+of\s+the|darken\s+(?:the\s+)?(?:appropriate|correct)\s+(?:circle|bubble|oval)|before\s+you\s+proceed\s+to\s+mark|fill\s+in\s+some\s+particulars)\b"
DIRECTIVE = r"(?i)^(?:before|after|do\s+not|write|read|fill|mark|ensure|check|keep|use|switch\s+off|note\b|all\s+questions?|time\s+allowed|maximum\s+marks?|this\s+(?:question|paper|booklet)|answer\s+all|attempt\s+all|rough\s+work|candidates?\s+(?:are|must|should|will))"
NUMBERING_CLASS = ("unnumbered-questions", "duplicate-question-numbers", "missing-question-numbers")
STRUCTURE_CLASS = ("invalid-match-payload", "incomplete-match-columns", "incomplete-match-stem", "regional-script", "short-or-empty-text", "incomplete-options", "broken-extraction")
HIDE_AT = 3

OPTIONS = ("option_a", "option_b", "option_c", "option_d")
QUESTION = ("question_text", *OPTIONS, "question_number", "exam_name", "question_type", "subject", "topic", "subtopic", "correct_answer", "answer_status", "needs_review", "has_image", "image_url", "explanation_status", "is_active")
STATE = ("structural_status", "answer_status", "explanation_status", "tagging_status", "review_required", "confidence_score", "public_visibility", "primary_issue_code", "issue_codes")


def _yes(x) -> Column:
    return F.lit(False) if x is None else F.coalesce(col(x).cast("boolean"), F.lit(False))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?U){pattern}")


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0)))


def _any_of(codes: Column, labels: tuple[str, ...]) -> Column:
    return F.arrays_overlap(codes, F.array(*map(F.lit, labels)))


def _answer() -> Column:
    return F.upper(strip("correct_answer"))


def image_dependent() -> Column:
    joined = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("question_text", *OPTIONS)))
    return _yes("has_image") | (F.coalesce(F.col("image_url"), F.lit("")) != "") | _has(joined, IMAGE)


def _match_codes(text: Column, options: Column, fallback: Column) -> list[Column]:
    """Codes of a match question: its JSON payload has two columns, or its stem says what is to be matched."""
    payload = F.try_parse_json(F.trim(F.substring_index(F.substring(text, F.instr(text, MATCH_MARK) + len(MATCH_MARK), F.length(text)), "\0", 1)))
    usable = payload.isNotNull() & F.schema_of_variant(payload).startswith("OBJECT")
    empty = lambda key: F.coalesce(F.to_json(F.try_variant_get(payload, f"$.{key}", "variant")), F.lit("null")).isin("null", "[]", "{}", '""', "0", "0.0", "false")
    marked = F.instr(text, MATCH_MARK) > 0
    match = (F.lower(F.coalesce(F.col("question_type"), F.lit(""))) == "match") | F.lower(text).contains("match the following") | (F.lower(strip("topic")) == "matching")
    stem = matched(F.regexp_replace(text, r"(?i)^match\s+the\s+following[:\s-]*", ""), "[A-Za-z0-9]")
    coded = (F.size(options) == 4) & F.forall(options, lambda o: o.rlike(MATCH_CODE))
    thin = coded & ((stem < LEAST_STEM) | ~_has(text, MATCH_PARTS))
    live = match & ~fallback
    return [F.when(live & marked & ~usable, "invalid-match-payload"), F.when(live & marked & usable & (empty("col1") | empty("col2")), "incomplete-match-columns"), F.when(live & ~marked & thin, "incomplete-match-stem")]


def issue_codes() -> Column:
    """The sorted distinct codes of a row."""
    text, answer, status = strip("question_text"), _answer(), F.lower(strip("answer_status"))
    options = F.filter(F.array(*(strip(o) for o in OPTIONS)), lambda o: o != "")
    n, image = filled(*OPTIONS), image_dependent()
    fallback = _yes("has_image") & (F.coalesce(F.col("image_url"), F.lit("")) != "") & (n == 4)
    inline = (n == 4) & (_count(text, INLINE_OPTION) >= 2)
    statements = _has(text, STATEMENTS) & F.forall(options, lambda o: F.length(o) <= LONGEST_OPTION)
    scripted = F.lower(F.coalesce(F.col("exam_name"), F.lit(""))).rlike("|".join(SCRIPTED_EXAMS))
    given = F.element_at(F.array(*(strip(o) for o in OPTIONS)), F.greatest(F.lit(1), F.array_position(F.array(*map(F.lit, LETTERS)), answer)).cast("int"))
    settled, lettered = status.isin("deleted", "multiple"), answer.isin(*LETTERS)
    codes = [
        F.when(F.coalesce(F.col("question_number"), F.lit(0)) <= 0, "unnumbered-questions"),
        F.when((F.length(text) < LEAST_TEXT) & ~fallback, "short-or-empty-text"),
        F.when(n < 4, F.when(image, "image-dependent-review").otherwise("incomplete-options")),
        F.when(inline & ~statements & ~fallback, "broken-extraction"),
        F.when(~scripted & ~fallback & (regional_ratio(F.concat_ws(" ", text, F.array_join(options, " "))) >= REGIONAL), "regional-script"),
        *_match_codes(text, options, fallback),
        F.when(_yes("needs_review"), "answer-review"),
        F.when(~settled & ~lettered, "invalid-answer"),
        F.when(~settled & lettered & (given == ""), "answer-option-missing"),
        F.when(F.lower(strip("subject")).isin(*NO_SUBJECT), "generic-subject-tag"),
        F.when(F.lower(strip("topic")).isin(*NO_TOPIC), "generic-topic-tag"),
        F.when(blank("subtopic"), "missing-subtopic-tag"),
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*codes))))


def with_quality(rows: DataFrame, explained: str | Column | None = None, contradicted: str | Column | None = None, codes: Column | None = None) -> DataFrame:
    """rows with the columns STATE, earlier ones replaced."""
    seen = rows.withColumns({"_codes": issue_codes() if codes is None else codes, "_explained": _yes(explained), "_contra": _yes(contradicted)})
    codes = F.col("_codes")
    structural, answer = F.array_intersect(codes, F.array(*map(F.lit, STRUCTURAL))), _any_of(codes, ANSWER)
    generic, status, broken = _any_of(codes, TAGGING[:2]), F.lower(strip("answer_status")), F.size(structural) > 0
    explanation = F.when(F.col("_contra"), "contradiction").when(F.col("explanation_status") == "stale", "stale").when(F.col("_explained"), "generated").otherwise("missing")
    weights = F.create_map(*(F.lit(x) for pair in PENALTY.items() for x in pair))
    lost = F.aggregate(codes, F.lit(0), lambda s, c: s + F.coalesce(F.try_element_at(weights, c), F.lit(0))) + F.when(explanation == "stale", STALE_PENALTY).otherwise(0)
    state = {
        "structural_status": F.when(broken, "broken").otherwise("valid"),
        "answer_status": F.when(status.isin("deleted", "multiple"), status).when(answer | ~_answer().isin(*LETTERS), "invalid").when(_yes("needs_review"), "ai_inferred").otherwise("verified"),
        "explanation_status": explanation,
        "tagging_status": F.when(generic, "weak").when(_any_of(codes, TAGGING), "partial").otherwise("strong"),
        "review_required": _yes("needs_review") | broken | answer | F.col("_contra") | generic,
        "confidence_score": F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)),
        "public_visibility": F.when(broken, "hidden_structural").when(F.col("_contra") | answer, "hidden_quality").when(~F.coalesce(F.col("is_active"), F.lit(True)), "hidden_admin").otherwise("visible"),
        "primary_issue_code": F.coalesce(F.try_element_at(structural, F.lit(1)), F.try_element_at(codes, F.lit(1))),
        "issue_codes": codes,
    }
    return seen.withColumns(state).drop("_codes", "_explained", "_contra")


def patched(rows: DataFrame, patch: str) -> DataFrame:
    """rows with what the map `patch` (column to text) sets, cast to the column's type (C3, before the state)."""
    kinds = dict(rows.dtypes)
    new = {c: F.when(F.map_contains_key(F.col(patch), c), F.try_element_at(F.col(patch), F.lit(c)).try_cast(kinds[c])).otherwise(F.col(c)) for c in rows.columns if c in (*QUESTION, "difficulty", "paper_id") and c != patch}
    return rows.withColumns(new)


def queue_class(codes: str | Column) -> Column:
    """(issue, severity, blocker, priority) of a row in the repair queue, the first that holds."""
    codes = col(codes)
    as_struct = lambda issue, severity, blocker, priority: F.struct(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), F.lit(blocker).alias("blocker"), F.lit(priority).alias("priority"))
    out = F.when(_any_of(codes, NUMBERING_CLASS), as_struct("numbering/data repair", "critical", "none", "P3"))
    out = out.when(_any_of(codes, STRUCTURE_CLASS), as_struct("structural manual review", "critical", "row", "P0"))
    out = out.when(F.array_contains(codes, "image-dependent-review"), as_struct("image/manual review", "medium", "row", "P1"))
    out = out.when(F.array_contains(codes, "answer-explanation-contradiction"), as_struct("explanation regeneration", "high", "row", "P1"))
    out = out.when(_any_of(codes, ("answer-review", "invalid-answer")), as_struct("answer verification", "medium", "none", "P3"))
    return out.otherwise(as_struct("answer verification", "low", "none", "P3"))


def instruction_like(text: str | Column, options: Column) -> Column:
    text = strip(text)
    return (text != "") & (_has(text, INSTRUCTION) | ((options < 2) & _has(text, DIRECTIVE)))


def extraction_score() -> Column:
    """What an extracted question is worth; may be negative."""
    text, n = strip("question_text"), filled(*OPTIONS)
    ratio = regional_ratio(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("question_text", *OPTIONS))))
    gains = [n * 250, F.least(F.length(text), F.lit(240)), F.when(F.col("question_number").isNotNull(), 25).otherwise(0), F.when(_answer().isin(*LETTERS), 20).otherwise(0), F.when(~_yes("needs_review"), 10).otherwise(0), F.least(F.lit(40), matched(text, "[A-Za-z]"))]
    losses = [F.when(ratio >= 0.35, 1200).when(ratio >= 0.12, 500).when(ratio >= 0.04, 120).otherwise(0), F.when(instruction_like(text, n), 1500).otherwise(0), F.when(n == 0, 120).otherwise(0), F.when(F.length(text) < LEAST_TEXT, 80).otherwise(0)]
    return sum(gains[1:], gains[0]) - sum(losses[1:], losses[0])


def cleaned(rows: DataFrame) -> DataFrame:
    """rows without regional script, less those that are no questions (C11)."""
    before = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("question_text", *OPTIONS, "passage") if c in rows.columns))
    fields = [c for c in ("question_text", *OPTIONS, "passage") if c in rows.columns]
    out = rows.withColumn("_regional", regional_ratio(before)).withColumns({c: strip_regional(c) for c in fields})
    english = sum((matched(F.col(c), "[A-Za-z]") for c in OPTIONS), matched(F.col("question_text"), "[A-Za-z]"))
    gone = (F.length(F.col("question_text")) < 5) | instruction_like("question_text", filled(*OPTIONS)) | ((F.col("_regional") >= 0.35) & (english < 20))
    return out.where(~gone).drop("_regional")


def repairs(rows: DataFrame, detected: str, options: str) -> DataFrame:
    """Repair proposals (question_id, repair_type, status, proposed_patch) from a detected answer and a map of cleaned
    options by letter (C24)."""
    letter = F.substring(F.upper(strip(detected)), 1, 1)
    answer = F.when(letter.isin(*LETTERS) & (letter != _answer()), F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in ("correct_answer", letter, "needs_review", "true", "answer_status", "corrected", "explanation_status", "stale"))))
    changed = []
    for x, o in zip(LETTERS, OPTIONS, strict=True):
        new = strip(F.try_element_at(F.col(options), F.lit(x)))
        changed.append(F.when((new != "") & (new != strip(o)), F.struct(F.lit(o).alias("key"), new.alias("value"))))
    entries = F.array_compact(F.array(*changed))
    option = F.when(F.size(entries) > 0, F.map_concat(F.map_from_entries(entries), F.create_map(F.lit("needs_review"), F.lit("true"))))
    made = F.array(F.struct(F.lit("answer_correction").alias("t"), answer.alias("p")), F.struct(F.lit("options_cleanup").alias("t"), option.alias("p")))
    out = rows.select(F.col("id").alias("question_id"), F.explode(F.filter(made, lambda r: r["p"].isNotNull())).alias("r"))
    return out.select("question_id", F.col("r.t").alias("repair_type"), F.lit("proposed").alias("status"), F.col("r.p").alias("proposed_patch"))


def repaired(rows: DataFrame, proposals: DataFrame, repair_type: str = "answer_correction") -> DataFrame:
    """rows with the newest proposed repair of that type put in and their state derived anew (C25).  What a repair says
    of the state itself holds."""
    newest = Window.partitionBy("question_id").orderBy(F.desc("created_at"), F.desc("id"))
    due = proposals.where((F.col("status") == "proposed") & (F.col("repair_type") == repair_type))
    due = due.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(F.col("question_id").alias("_q"), F.col("proposed_patch").alias("_patch"))
    joined = rows.join(due, F.col("id") == F.col("_q"), "left").withColumn("_had", F.col("explanation_status") == "generated")
    out = with_quality(patched(joined, "_patch"), "_had")
    said = {c: F.coalesce(F.try_element_at(F.col("_patch"), F.lit(c)).cast(k), F.col(c)) for c, k in out.dtypes if c in STATE and k != "array<string>"}
    return out.withColumns(said).drop("_q", "_patch", "_had")


def with_history(rows: DataFrame, proposals: DataFrame, types: tuple[str, ...] = ("answer_correction", "options_cleanup")) -> DataFrame:
    """rows with all proposed repairs of these types put in, oldest first, so that of two that set a column the newer one holds
    (created_at, then id); the state is derived once, after them (C25 with C3).  applied holds the ids of the repairs that count, and
    overruled those of which nothing is left.  A repair without a question or a patch is neither.

    What each column takes is the newest of its values, found by a maximum for each question and column, so a long history of one
    question is never gathered; only its columns are."""
    due = proposals.where((F.col("status") == "proposed") & F.col("repair_type").isin(*types) & F.col("question_id").isNotNull())
    each = due.select("question_id", "created_at", "id", F.explode("proposed_patch").alias("key", "value"))
    turn = F.struct(F.col("created_at").isNotNull(), "created_at", "id")
    newest = each.groupBy("question_id", "key").agg(F.max_by("value", turn).alias("value"), F.max_by("id", turn).alias("by"))
    final = newest.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_patch"), F.array_sort(F.collect_set("by")).alias("applied"))
    lost = each.select("question_id", "id").distinct().join(newest.select(F.col("question_id"), F.col("by").alias("id")).distinct(), ["question_id", "id"], "left_anti").groupBy(F.col("question_id").alias("_l")).agg(F.array_sort(F.collect_list("id")).alias("overruled"))
    joined = rows.join(final.withColumnRenamed("question_id", "_q"), F.col("id") == F.col("_q"), "left").withColumn("_had", F.col("explanation_status") == "generated")
    touched = with_quality(patched(joined, "_patch"), "_had")
    said = {c: F.coalesce(F.try_element_at(F.col("_patch"), F.lit(c)).try_cast(k), F.col(c)) for c, k in touched.dtypes if c in STATE and k != "array<string>"}
    out = touched.withColumns(said).join(lost, F.col("id") == F.col("_l"), "left")
    none = F.array().cast(dict(due.select(F.array("id").alias("x")).dtypes)["x"])
    return out.withColumns({"applied": F.coalesce("applied", none), "overruled": F.coalesce("overruled", none)}).drop("_q", "_patch", "_had", "_l")


def hidden_by_flags(flags: DataFrame, at_least: int = HIDE_AT) -> DataFrame:
    """question_id, flags, hidden: one flag counts per user and question, and all flags without a user (R6, batch)."""
    users = F.count_distinct("user_id") + F.count(F.when(F.col("user_id").isNull(), 1))
    return flags.groupBy("question_id").agg(users.alias("flags")).withColumn("hidden", F.col("flags") >= at_least)


def baseline(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    """Per (exam, year, shift) the eight counts, the sorted ids and the SHA-256 of these, one a line (A27).  The sorted list
    is itself a result, so the ids of a group must be in one place."""
    explained = explanations.select(strip(F.col("question_id").cast("string")).alias("_id")).where("_id <> ''").distinct().withColumn("_explained", F.lit(True))
    active = F.coalesce(F.col("is_active"), F.lit(False))
    shown = F.when(F.col("public_visibility").isNotNull(), F.col("public_visibility") == "visible").otherwise(active)
    rows = rows.withColumns({"_id": strip(F.col("id").cast("string")), "_shown": shown}).join(explained, "_id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    shift = F.when(blank("shift_label"), "NO_SHIFT").otherwise(strip("shift_label"))
    out = rows.groupBy(strip("exam_name").alias("exam_name"), F.coalesce("exam_year", F.lit(0)).alias("exam_year"), shift.alias("shift_label")).agg(
        F.count("*").alias("question_count"), n(active).alias("active_count"), n(F.col("_shown")).alias("visible_count"), n(~F.col("_shown")).alias("hidden_count"), n(F.col("practice_ready")).alias("practice_ready_count"), n(F.col("needs_review")).alias("needs_review_count"),
        n(F.col("structural_status") == "broken").alias("structural_broken_count"), n(F.col("_explained")).alias("explanation_count"), F.array_sort(F.collect_list(F.when(F.col("_id") != "", F.col("_id")))).alias("question_ids"),
    )
    return out.withColumn("question_id_hash", F.sha2(F.array_join("question_ids", "\n").cast("binary"), 256))
