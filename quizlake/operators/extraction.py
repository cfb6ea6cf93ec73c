"""Text of scanned papers and books: clean-up, options in raw blocks, kinds of pages, formats, years, validators, drafts.

Everything is a column over one row, so a text is read once and never leaves the JVM; groups are by page, book or document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, col, collapse, matched, strip
from . import blocks as B
from . import quality as Q
from .identity import carried_forward, winners

# Patterns, their order, labels and limits decide the results.
LAYER = [
    (r"(?<!\n) +(?=\([1-4]\) )", "\n"),
    (r"(?<!\n) {2,}(?=\([ABCDabcd]\) )", "\n"),
    (r"(?iU)Page\s+\d+\s+of\s+\d+", ""),
    (r"(?U)\bP\.T\.O\.?\s*", ""),
    (r"(?iU)\bM\s*A\s*S\s*T\s*E\s*R\s*C\s*O\s*P\s*Y\b", ""),
    (r"(?U)\bET\s*(?:X\s*)?\d+(?:\s*[A-Z])?\b", ""),
    (r"(?U)\n(?:PART|SECTION|Section|Part)\s*[-–—]?\s*[A-Fa-f0-9IVXivx]+\s*(?:\n|$)", "\n"),
    (r"(?iU)(?:\n|^)[ \t]*Space\s+for\s+Rough\s+Work[^\n]*", ""),
    (r"(?U)\n[\w][\w\-]+\s*\n\s*\(\s*\d{2,3}\s*\)\s*(?=\n)", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
    (r"(?U)(\n(?:Q\.?\s*)?\d{1,3}[.)])\s*\n\s+(?=\S)", "$1 "),
    (r"(?U)\n[\w][\w\-]+[ \t]*\(\s*\d{2,3}\s*\)(?=[ \t]*(?:\n|$))", ""),
]
LIGATURES = [
    (r"(?U)([A-Za-z]) ng\b", "$1ting"),
    (r"(?U)([A-Za-z]) ve(ly|ness|r|rs|d|s)?\b", "$1tive$2"),
    (r"(?U)(?<=[a-zA-Z])u on(s)?\b", "ution$1"),
    (r"(?U)uc on(s)?\b", "uction$1"),
    (r"(?U)ec on(s)?\b", "ection$1"),
    (r"(?iU)\bcompetive\b", "competitive"),
    (r"(?iU)\bcompetively\b", "competitively"),
    (r"(?iU)\brepeti ve\b", "repetitive"),
    (r"(?iU)\bquantita ve\b", "quantitative"),
    (r"(?iU)\bquali ta ve\b", "qualitative"),
]
STOP = ("&", "of", "the", "and", "in", "at", "to", "a", "an")
OPTION_ANCHOR = r"(?<![A-Za-z0-9])\(?([A-Da-d])[).:-]"
WATERMARK = r"(?iU)(?:tg\s*@|@[\w_]{3,}|free\s*pdf\s*hall|pdf\s*hall|exams?_pdfs?|freemebhaii)"
KEY_HEADING = r"(?imU)^\s*(answer\s*key|answers?)\s*:?\s*$"
KEY_PAIR = r"(?iU)\b\d{1,4}\s*[-.:)]?\s*[A-D]\b"
SOLUTION = r"(?iU)\b(sol(?:ution)?s?\.?|shortcut|trick|method|ratio method|alternate method|atq)\b"
NUMBERED = r"(?mU)^\s*(?:q(?:uestion)?\s*)?\d{1,4}[).:-]"
OPTION = r"(?U)(?:(?<=\s)|^)[A-D][).:-]\s*"
HEADING = r"(?iU)\b(percentages?|profit|loss|discount|ratio|average|mixture|time and work|simple interest|compound interest|type\s*[ivx\d]+|pattern|ratio method)\b"
KEY_LINE = r"(?iU)^(solutions?|answer\s*key|answers?)$"
SPECIAL, KEY, SOLVED, QUESTIONS, NOISE = "mixed_special_page", "answer_key_page", "solution_page", "question_page", "ignore_noisy_page"
YEAR = "20(?:1[1-9]|2[0-5])"
READY = tuple(B.STATUS.values())
KEY_TEXT = r"(?U)f\W*i\W*n\W*a\W*l\W*k\W*e\W*y|i\W*n\W*i\W*t\W*i\W*a\W*l\W*k\W*e\W*y|f\W*a\W*l\W*k"

PAYLOAD = "\n\n" + Q.MATCH_MARK


def _folded(x, rules) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, rule[0], rule[1]), rules, F.coalesce(col(x), F.lit("")))


def text_layer(pages) -> Column:
    """The pages of a document joined and freed of footers, watermarks and headings; options on one line get lines of their own."""
    return _folded(F.array_join(pages, "\n\n"), LAYER)


def with_ligatures(x) -> Column:
    """Words that lost the ligature ti, made whole."""
    return _folded(x, LIGATURES)


def tagging_context(place) -> Column:
    """What a question is tagged by: place, kind, 320 characters of the stem without a match payload, 120 of each option."""
    text = F.coalesce("question_text", F.lit(""))
    stem = strip(F.substring(F.when(F.instr(text, PAYLOAD) > 0, F.substring_index(text, PAYLOAD, 1)).otherwise(text), 1, 320))
    options = F.array_compact(F.array(*(F.when(~blank(o), F.concat(F.lit(f"{x}. "), F.substring(strip(o), 1, 120))) for x, o in zip(Q.LETTERS, Q.OPTIONS, strict=True))))
    kind = strip(F.when(F.coalesce("question_type", F.lit("")) == "", "MCQ").otherwise(F.col("question_type")))
    head = F.concat(col(place).cast("string"), F.lit(". [type: "), kind, F.lit("] "), stem)
    return F.when(F.size(options) > 0, F.concat(head, F.lit("\nOptions: "), F.array_join(options, " | "))).otherwise(head)


def topic_bucket(subject, raw, topics: dict[str, list[str]], overrides: dict[str, dict[str, str]] | None = None) -> Column:
    """raw as one of the subject's topics (X22): the same, the same in another case, one inside the other, by a keyword, by most
    words in common; otherwise, and for unknown subjects, as it is."""
    pair = "array<struct<word:string,topic:string>>"
    table = lambda d, kind: F.create_map(*(c for k, v in d.items() for c in (F.lit(k), v))) if d else F.lit(None).cast(f"map<string,{kind}>")
    known = F.try_element_at(table({k: F.array(*map(F.lit, v)) for k, v in topics.items()}, "array<string>"), col(subject))
    words = {k: F.array(*(F.struct(F.lit(w).alias("word"), F.lit(m).alias("topic")) for w, m in v.items())) for k, v in (overrides or {}).items() if v}
    keyed = F.try_element_at(table(words, pair), col(subject))
    raw, low = col(raw), F.lower(strip(raw))
    content = lambda x: F.array_distinct(F.filter(F.split(collapse(F.lower(x)), " "), lambda w: ~w.isin(*STOP) & (F.length(w) > 2)))
    first = lambda test: F.try_element_at(F.filter(known, test), F.lit(1))
    common = F.array_max(F.transform(known, lambda c, i: F.struct(F.size(F.array_intersect(content(low), content(c))).alias("n"), (-i).alias("i"), c.alias("c"))))
    by_word = F.try_element_at(F.filter(keyed, lambda o: F.contains(low, o["word"])), F.lit(1))["topic"]
    found = F.coalesce(first(lambda c: c == raw), first(lambda c: F.lower(c) == low), first(lambda c: F.contains(low, F.lower(c)) | F.contains(F.lower(c), low)), by_word, F.when(common["n"] > 0, common["c"]))
    return F.when(F.coalesce(raw, F.lit("")) == "", raw).otherwise(F.coalesce(found, raw))


# options in raw blocks


def isolated(blocks: DataFrame, text: str = "raw_block_text") -> DataFrame:
    """blocks with stem_text, options (by letter), option_anchors, options_recovered_count, option_isolation_confidence and
    isolation_notes (X29).

    A letter with a bracket, point, colon or dash begins an option; lines without one go on with the option before them, or
    with the stem.  The text is cut at all anchors at once.  A null or empty text has no options, confidence 0 and one note.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    out = blocks.withColumn("_text", F.array_join(lines, "\n"))
    out = out.withColumn("_cut", F.split(F.regexp_replace("_text", OPTION_ANCHOR, "\x01$1"), "\x01"))
    # an anchor's own line loses dashes, colons and tabs at its ends, whole lines after it only white space
    part = lambda s: F.transform(F.split(F.substring(s, F.lit(2), F.length(s)), "\n"), lambda x, i: F.when(i == 0, F.regexp_replace(x, r"^[ :\t-]+|[ :\t-]+$", "")).otherwise(strip(x)))
    out = out.withColumn("_parts", F.transform(F.slice("_cut", 2, F.greatest(F.size("_cut") - 1, F.lit(0))), lambda s: F.struct(F.upper(F.substring(s, 1, 1)).alias("label"), part(s).alias("lines"))))
    out = out.withColumns({"stem_text": strip(F.col("_cut")[0]), "option_anchors": F.transform("_parts", lambda p: p["label"])})
    said = lambda x: strip(F.array_join(F.filter(F.flatten(F.transform(F.filter("_parts", lambda p: p["label"] == x), lambda p: p["lines"])), lambda s: s != ""), "\n"))
    out = out.withColumn("options", F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(x).alias("key"), said(x).alias("value")) for x in Q.LETTERS)), lambda e: e["value"] != "")))
    kinds = F.array_distinct("option_anchors")
    n, unique, anchored = F.size("options"), F.size(kinds), F.size("option_anchors") > 0
    ordered = kinds == F.array_sort(kinds)
    last_break = F.coalesce(F.array_max(F.transform("_parts", lambda p, i: F.when(F.size(p["lines"]) > 1, i))), F.lit(-1))
    letters = matched("stem_text", "[A-Za-z]")
    wrapped = F.exists("_parts", lambda p: F.exists(F.slice(p["lines"], 2, F.greatest(F.size(p["lines"]) - 1, F.lit(0))), lambda s: s != ""))
    bare = F.exists(F.transform("_parts", lambda p, i: (p["lines"][0] == "") & (i <= last_break)), lambda b: b)
    no_text, no_stem = F.col("_text") == "", F.col("stem_text") == ""
    notes = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, when in {"wrapped_option_line": wrapped, "empty_option_anchor": bare, "option_anchor_order_irregular": ~ordered, "anchors_without_option_text": anchored & (n == 0), "stem_missing": no_stem, "stem_short": ~no_stem & (letters < 12)}.items())))
    sure = F.when((n >= 4) & (unique >= 4), 0.9).when((n >= 3) & (unique >= 3), 0.76).when((n >= 2) & (unique >= 2), 0.62).when(anchored, 0.45).otherwise(0.0)
    sure = sure - F.when(no_stem, 0.1).when(letters < 12, 0.08).otherwise(0.0) - F.when(ordered, 0.0).otherwise(0.1)
    out = out.withColumns({
        "options_recovered_count": n, "option_isolation_confidence": F.when(no_text, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.95), sure)), 2)),
        "isolation_notes": F.when(no_text, F.array(F.lit("empty_raw_block"))).otherwise(notes),
    })
    return out.drop("_text", "_cut", "_parts")


def audited(blocks: DataFrame) -> DataFrame:
    """The readiness audit of raw blocks with the options it finds itself (C26 over X29)."""
    return B.audited(isolated(blocks))


def drafts(blocks: DataFrame) -> DataFrame:
    """The ready ones of audited blocks as draft questions (C28): question_number, question_text, option_a to option_d and
    normalization_notes, or failure with the first thing that is lacking."""
    out = B.ready(blocks)
    number = F.col("question_number_raw")
    stem = strip(F.regexp_replace("stem_text", F.concat(F.lit(r"(?U)^\s*"), F.when(number.rlike("^[0-9]+$"), number).otherwise(""), F.lit(r"\s*[).:-]?\s*")), F.lit("")))
    short = F.exists(F.array(*map(F.lit, Q.LETTERS)), lambda x: ~F.coalesce(F.map_contains_key("options", x), F.lit(False)))
    failure = F.when(short, "normalized_options_missing").when(B.number().isNull(), "normalized_question_number_invalid").when(F.col("stem_text") == "", "normalized_stem_missing").when(stem == "", "normalized_stem_missing_after_number_strip")
    notes = F.concat(F.when(F.col("option_isolation_confidence") < 0.9, F.array(F.lit("option_isolation_not_perfect"))).otherwise(F.array().cast("array<string>")), F.col("isolation_notes"))
    made = {"question_number": B.number(), "question_text": stem, **{o: F.try_element_at("options", F.lit(x)) for x, o in zip(Q.LETTERS, Q.OPTIONS, strict=True)}, "normalization_notes": notes}
    out = out.withColumn("failure", failure)
    return out.withColumns({k: F.when(F.col("failure").isNull(), v) for k, v in made.items()})


def page_readiness(blocks: DataFrame, pages: DataFrame, top: int = 4) -> DataFrame:
    """Audited blocks by page (A34): counts of each status, blocks with anchors, incomplete options, the `top` reasons as
    reason:count (the most frequent, then by name) and the page's own status.  pages (page_number, withheld) lists all pages;
    one without blocks is withheld."""
    first, second, last = READY
    n = lambda s: F.count_if(F.col("status") == s)
    by_page = blocks.groupBy("page_number").agg(F.count("*").alias("question_block_count"), *(n(s).alias(f"{s}_count") for s in READY), F.count_if(F.size("option_anchors") > 0).alias("option_anchor_blocks"), F.count_if(F.array_contains("failure_reasons", "option_incomplete")).alias("option_incomplete_count"))
    out = pages.join(by_page, "page_number", "left").join(top_reasons(blocks, ["page_number"], top), "page_number", "left").na.fill(0, by_page.columns[1:])
    status = F.when(F.coalesce("withheld", F.lit(False)) | (F.col(f"{first}_count") > 0), first).when(F.col(f"{second}_count") > 0, second).when(F.col("question_block_count") > 0, last).otherwise(first)
    return out.withColumns({"page_readiness": status, "top_failure_reasons": F.coalesce("top_failure_reasons", F.array().cast("array<string>"))})


def top_reasons(blocks: DataFrame, key: list[str], top: int) -> DataFrame:
    """The most frequent failure reasons of each key, or of all blocks without one; there are some twenty different ones."""
    counts = blocks.select(*key, F.explode("failure_reasons").alias("reason")).groupBy(*key, "reason").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("reason").alias("reason"))))
    return counts.groupBy(*key).agg(F.transform(F.slice(ranked, 1, top), lambda x: F.concat_ws(":", x["reason"], (-x["n"]).cast("string"))).alias("top_failure_reasons"))


# pages and documents


def _heading(top) -> Column:
    """A page's heading: a line that announces keys or solutions, then one that names a pattern, then a short one in capitals."""
    tidy = F.transform(F.split(F.coalesce(col(top), F.lit("")), r"\r\n|[\n\r]"), lambda x: F.regexp_replace(x, r"^[ :\t-]+|[ :\t-]+$", ""))
    first = lambda test: F.substring(F.try_element_at(F.filter(tidy, test), F.lit(1)), 1, 120)
    own = lambda x: ~x.rlike(WATERMARK)
    return F.coalesce(first(lambda x: x.rlike(KEY_LINE)), first(lambda x: (F.length(x) >= 3) & own(x) & x.rlike(HEADING)), first(lambda x: F.length(x).between(3, 80) & (F.upper(x) == x) & own(x)))


def page_kinds(pages: DataFrame) -> DataFrame:
    """pages (text, top_text, column_count, has_diagram, image_count, drawing_count, text_block_count) with page_type,
    confidence, heading and reasons, from how often marks of questions, options, keys and solutions stand on a page (X30)."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), r"\r\n|[\n\r]")
    out = pages.withColumn("_t", strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")))
    n = lambda pattern: F.regexp_count("_t", F.lit(pattern))
    out = out.withColumns({"_marks": n(WATERMARK), "_pairs": n(KEY_PAIR), "_solved": n(SOLUTION), "_options": n(OPTION), "_numbers": n(NUMBERED), "_keys": F.col("_t").rlike(KEY_HEADING), "heading": _heading("top_text")})
    tight = F.length(F.regexp_replace("_t", r"(?U)\s+", ""))
    out = out.withColumns({"_noisy": (F.col("_marks") >= 2) & ((tight < 300) | (F.col("_marks") * 18 >= tight)), "_asked": F.greatest(F.lit(0), F.col("_numbers") + F.floor(F.col("_options") / 4).cast("int") - F.col("_solved"))})
    size, asked, pairs, solved, options, noisy = F.length("_t"), F.col("_asked"), F.col("_pairs"), F.col("_solved"), F.col("_options"), F.col("_noisy")
    written = F.size(F.filter(F.split("_t", "\n"), lambda x: ~blank(x)))
    headed, diagram = F.col("heading").isNotNull(), F.coalesce("has_diagram", F.lit(False))
    at = lambda c: F.coalesce(F.col(c), F.lit(0))
    told = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), (sure if isinstance(sure, Column) else F.lit(sure)).cast("double").alias("sure"))
    by_key = F.when((asked >= 2) | (solved >= 2), told(SPECIAL, 0.74)).otherwise(told(KEY, F.when(pairs >= 24, 0.95).otherwise(0.87)))
    by_solution = F.when((asked >= 1) | (pairs >= 6) | (options >= 4), told(SPECIAL, 0.73)).otherwise(told(SOLVED, F.when(written >= 8, 0.88).otherwise(0.8)))
    verdict = F.when((size < 60) & noisy & (asked == 0) & (pairs == 0) & (solved == 0), told(NOISE, 0.94)).when(F.col("_keys") | (pairs >= 18), by_key).when(solved >= 2, by_solution)
    verdict = verdict.when((asked >= 2) | ((options >= 6) & (size >= 180)) | (headed & F.coalesce(F.col("heading").rlike(HEADING), F.lit(False)) & (asked >= 1)), told(QUESTIONS, F.when(asked >= 3, 0.86).otherwise(0.8)))
    verdict = verdict.when(headed & diagram, told(SPECIAL, 0.7)).when(noisy & (size < 180), told(NOISE, 0.82)).when((at("image_count") > 0) | (at("drawing_count") > 0) | (at("text_block_count") == 0), told(SPECIAL, 0.64)).otherwise(told(SPECIAL, 0.52))
    count = lambda name, c: F.when(c > 0, F.concat(F.lit(f"{name}="), c.cast("string")))
    reasons = [F.concat(F.lit("heading_detected="), F.col("heading")), F.when(F.col("_keys"), "answer_key_heading"), count("answer_pairs", pairs), count("solution_markers", solved), count("question_blocks", asked), count("option_markers", options), count("watermark_hits", F.col("_marks")), F.when(noisy, "watermark_dominant"), F.when(at("column_count") > 1, F.concat(F.lit("columns="), F.col("column_count").cast("string"))), F.when(diagram, "visual_density_or_diagram")]
    out = out.withColumns({"_v": verdict, "reasons": F.array_compact(F.array(*reasons))})
    return out.withColumns({"page_type": F.col("_v.kind"), "confidence": F.col("_v.sure")}).drop("_t", "_marks", "_pairs", "_solved", "_options", "_numbers", "_keys", "_noisy", "_asked", "_v")


def paper_format(pages, file_name, green=None, boxed=None) -> Column:
    """The format of a paper from the texts of its pages in order, its file's name and two findings of its layout: answers in
    green on the first two pages, boxes around the options (X31).  The first detector that holds decides."""
    texts = F.transform(F.coalesce(col(pages), F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    low = F.transform(texts, F.lower)
    green, boxed = (F.coalesce(x, F.lit(False)) if x is not None else F.lit(False) for x in (green, boxed))
    name = F.lower(F.coalesce(col(file_name), F.lit("")))
    any_in = lambda x, words: reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words))
    system = F.exists(F.slice(low, 1, 10), lambda p: any_in(p, ("tcsion cae", "tcsion.com")) & F.contains(p, F.lit("question id")))
    chosen = F.exists(F.slice(low, 1, 2), lambda p: any_in(p, ("chosen option", "status : ")) & p.rlike(r"(?mU)^(q\s*.\s*\d+|\d+\s*.)"))
    first = F.slice(low, 1, 6)
    authority = F.exists(first, lambda p: any_in(p, ("andhra pradesh public service commission", "appsc")))
    key_text = F.exists(first, lambda p: p.rlike(KEY_TEXT))
    key_name, board_name = any_in(name, ("finalkey", "initialkey", "final_key", "initial_key")), any_in(name, ("appsc", "fbo", "abo", "group", "screening"))
    keyed = (authority & (key_text | boxed)) | (key_name & boxed) | (key_name & board_name & key_text)
    checked = F.slice(texts, 1, 5)
    letters = F.aggregate(F.transform(checked, lambda p: F.length(strip(p))), F.lit(0), lambda a, b: a + b) / F.greatest(F.lit(1), F.size(checked))
    return F.when(system, "tcsion_cbt").when(green | chosen, "telegram_cbt").when(keyed, "appsc_boxed").when(letters < 50, "scanned_image").otherwise("digital_mcq")


def year_spans(pages: DataFrame, document: str = "document", page: str = "page", footer: str = "footer") -> DataFrame:
    """First and last page of each year of a combined document (S9, N6): a footer's first year holds until the next one, pages
    before any year belong to none.  A year that comes again spans what lies between."""
    found = pages.withColumn("year", F.nullif(F.regexp_extract(F.coalesce(F.col(footer), F.lit("")), YEAR, 0), F.lit("")).cast("int"))
    told = carried_forward(found, document, "year", page).where("year IS NOT NULL")
    return told.groupBy(document, "year").agg(F.min(page).alias("first_page"), F.max(page).alias("last_page"), F.count("*").alias("pages"))


# validators


def _numbered(number) -> Column:
    """The number if it is digits, white space around them let pass, else null."""
    return F.when(strip(col(number).cast("string")).rlike(r"^[0-9]+$"), strip(col(number).cast("string")).try_cast("int"))


def checked(number="question_number", text="question_text", options=Q.OPTIONS) -> Column:
    """(ok, reasons, question_number) of an object that a model made."""
    lacking = [F.when(_numbered(number).isNull(), "missing_or_invalid_question_number"), F.when(blank(text), "empty_question_text"), *(F.when(blank(o), f"missing_{name}") for o, name in zip(options, Q.OPTIONS, strict=True))]
    reasons = F.array_compact(F.array(*lacking))
    return F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), _numbered(number).alias("question_number"))


def checked_strictly(number="question_number", text="question_text", options=Q.OPTIONS) -> Column:
    """The second form of checked: options that are equal but for signs, or that hold no letter or digit, are reasons too."""
    tidy = [F.lower(F.regexp_replace(collapse(o), r"[^A-Za-z0-9%./+-]+", "")) for o in options]
    told = F.array_compact(F.array(*(F.when(~blank(o), x) for o, x in zip(options, tidy, strict=True))))
    noise = reduce(lambda a, b: a | b, (~blank(o) & ~col(o).rlike("[A-Za-z0-9]") for o in options))
    lacking = [F.when(_numbered(number).isNull(), "missing_or_invalid_question_number"), F.when(blank(text), "empty_question_text"), *(F.when(blank(o), f"missing_option_{i + 1}") for i, o in enumerate(options))]
    lacking += [F.when((F.size(told) >= 2) & (F.size(F.array_distinct(told)) < F.size(told)), "duplicate_options"), F.when(noise, "option_noise")]
    reasons = F.array_compact(F.array(*lacking))
    return F.struct((F.size(reasons) == 0).alias("ok"), reasons.alias("reasons"), _numbered(number).alias("question_number"))


def pattern_label(raw, fallback) -> Column:
    """A pattern's heading without signs at its ends and a page number; the fallback for what is no heading."""
    text = collapse(F.regexp_replace(strip(F.regexp_replace(collapse(raw), r"^[=—\-:;| ]+|[=—\-:;| ]+$", "")), r"(?U)\s+\d{1,3}$", ""))
    fallback = F.coalesce(col(fallback), F.lit(""))
    low, other = F.lower(text), F.lower(fallback)
    bad = (text == "") | (F.length(text) > 120) | text.rlike(r"(?U)^\d{2,4}\.") | (F.contains(low, F.lit("ssc chsl")) & (F.size(F.split(text, " ")) > 8)) | ((matched(text, r"(?U)\d") >= 10) & (matched(text, "[A-Za-z]") < 20))
    chapter = F.startswith(low, F.lit("chapter")) & (fallback != "") & (fallback != "General Pattern") & ~F.startswith(other, F.lit("chapter"))
    return F.when(bad | chapter, fallback).otherwise(text)


def book_rows(rows: DataFrame, chapter: str, place: str = "position") -> DataFrame:
    """Questions of a book as rows to store (D15): the first of each number, with its pattern, and sort_place by page, number
    and text within the book.  Rows without a number are left out."""
    named = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("pattern_tag", "detected_pattern_heading")), F.col(chapter), F.lit(""))
    tag = F.when(blank(named), F.col(chapter)).otherwise(strip(named))
    out = winners(rows.where("question_number IS NOT NULL"), ["book_id", "question_number"], [F.asc(place)])
    out = out.select("book_id", "question_number", strip("question_text").alias("question_text"), *(strip(o).alias(o) for o in Q.OPTIONS), F.lit("Medium").alias("difficulty"), tag.alias("pattern_tag"), F.col("source_page_number").alias("source_page"))
    late = F.lit(10**9)
    far = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)), late)
    return out.withColumn("sort_place", F.row_number().over(Window.partitionBy("book_id").orderBy(far("source_page"), far("question_number"), "question_text")))
