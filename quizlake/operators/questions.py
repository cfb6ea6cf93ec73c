"""Questions out of plain text: block parser (X23), winners by number (D9), match tables rebuilt from interleaved lines.

What depends on lines before (where a question starts, which line goes on with the one above) is a scan of one document in an
Arrow task, linear in its length.  All else (layouts, options, answers, filters, order of keys, payloads) are columns.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, filled, strip
from . import quality as Q
from .extraction import text_layer
from .identity import winners
from .upkeep import answer_fragment

# Patterns and limits decide the results.
HEAD = re.compile(r"[^\S\n]*(?:(?:Q\.?\s*)?(\d{1,3})[.)]|Question\s+Number\s*[:.-]\s*(\d{1,3})[.)]?)\s*", re.IGNORECASE)
LISTED = re.compile(r"(?:consider|following\s+(?:statement|list|fact|pair|column)|given\s+below|select\s+the|arrange|match|assert|reason|list\s+[I-V]|column\s+[A-D]|which\s+of\s+the|statements?\b|pairing|combination|correct\s+(?:statement|answer|code)|incorrect\s+statement|true\s+statement)", re.IGNORECASE)
NUMBERED_LINE = re.compile(r"\n\s*\d+[.)]\s+\S[^\n]{2,}")
INTRODUCES = re.compile(r"[:;,]\s*$")
LOOK_BACK, NEAR, BLANK_WITHIN, AHEAD, JUMP, OPENING = 250, 120, 30, 6, 20, 50
ALPHA_CUT, NUMERIC_CUT, HEADER_CUT = r"(?sU)(?=\n\s*[(\[]?[AaBbCcDd][)\].]\s+)", r"(?sU)(?=\n\s*\([1-4]\)\s+)", r"(?iU)\bOptions\s*:\s*"
ALPHA_OPTION = r"(?sU)(?:^|\n)\s*[(\[]?([AaBbCcDd])[)\].]\s+(.+?)(?=\n\s*[(\[]?[AaBbCcDd][)\].]|\n\s*(?:Q\.?\s*)?\d{1,3}[.)]\s|\z)"
NUMERIC_OPTION = r"(?sU)(?:^|\n)\s*\(([1-4])\)\s+(.+?)(?=\n\s*\([1-4]\)\s|\n\s*(?:Q\.?\s*)?\d{1,3}[.)]\s|\z)"
ALPHA_ANSWER = r"(?i)(?:Ans(?:wer)?\.?|ANS)[ \t]*[:\-][ \t]*[(\[]?([AaBbCcDd])[)\]]?"
NUMERIC_ANSWER = r"(?i)(?:Ans(?:wer)?\.?|ANS)[ \t]*[:\-][ \t]*[(\[]?([1-4])[)\]]?"
STEM = [(r"(?U)^(?:Q\.?\s*)?\d{1,3}[.)]\s+", ""), (r"(?isU)Question\s+Number\s*:\s*\d+\s+Question\s+Id\s*:.*?Correct\s+Marks\s*:\s*\d+\s*", "")]
LABELS_AFTER = r"(?U)(?:\s+[A-D]\.\s*)+\z"
OPTION_ENDS = [
    LABELS_AFTER,
    r"(?iUd)\s*[\(\[]1[\)\]]\s*(?:[A-D](?:\s+(?:and|only|,)\s*[A-D]?)?|All\s+of|None\s+of|Both\s+[A-D]).{0,80}\z",
    r"(?isU)\s+(?:Which\s+of\s+the\s+above|Choose\s+the\s+correct|Select\s+the\s+correct|The\s+correct\s+(?:answer|option|code)|Which\s+of\s+the\s+following\s+(?:combination|code|pair|option))\b.*\z",
    r"(?isU)\bM\s*A\s*S\s*T\s*E\s*R\s*C\s*O\s*P\s*Y\b.*\z",
    r"(?Ud)\bET\s*(?:X\s*)?\d+\b.*\z",
    LABELS_AFTER,
    r"(?sU)\s+[^\x00-\x7F].*\z",
]
SHEET_LINE = r"(?iU)^(?:Options\s*:|Question\s+Id\s*:|Option\s+Shuffling\s*:|Is\s+Question\s+Mandatory\s*:|Calculator\s*:|Response\s+Time\s*:|Think\s+Time\s*:|Minimum\s+Instruction\s+Time\s*:|Correct\s+Marks\s*:|Wrong\s+Marks\s*:|https?://|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4},)"
SHEET_NUMBER, BARE_NUMBER = r"(?iU)Question\s+Number\s*[:.-]\s*\d+\b", r"^[1-4][.)]?$"
PICTURE = Q.IMAGE.replace(r"|dice|venn\s+diagram", "")
LEAST_STEM, OPTION_WORTH = 10, 200
FIELDS = ("question_number", "question_text", *Q.OPTIONS, "correct_answer", "needs_review")


# where questions start


def candidates(text: str):
    """(start, number, whether it says so itself) of each line that begins with a number.  The start takes blank lines before it in;
    a number alone on its line takes the next line in, which therefore begins nothing."""
    at, blank = 0, None
    while at <= len(text):
        found = HEAD.match(text, at)
        end = text.find("\n", found.end() if found else at)
        end = len(text) if end < 0 else end
        if found:
            yield (at if blank is None else blank), found[1] or found[2], bool(found[2])
            blank = None
        elif text[at:end].strip():
            blank = None
        elif blank is None:
            blank = at
        at = end + 1


def question_starts(text: str) -> list[tuple[int, int]]:
    """(number, start) of the candidates that are questions: numbers go up, by JUMP at most; one that has lost its first digits
    counts as the next one after a blank line; numbered statements inside of a question are none."""
    out, last = [], 0
    for start, digits, says_so in candidates(text):
        before = text[max(0, start - LOOK_BACK) : start]
        apart = says_so or start < OPENING or "\n\n" in before[-BLANK_WITHIN:] + text[start : start + AHEAD]
        number, due = int(digits), str(last + 1)
        if not last < number <= last + JUMP:
            cut = len(str(number)) < len(due) and due.endswith(str(number))
            if not (cut and apart) or LISTED.search(before) or INTRODUCES.search(before.strip()):
                continue
            number = last + 1
        if not apart and (NUMBERED_LINE.search(before[-NEAR:]) or LISTED.search(before)):
            continue
        last = number
        out.append((number, start))
    return out


def question_blocks(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, position, question_number, block: a row for each question of each document."""
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            at, places, numbers, blocks = [], [], [], []
            for i, body in enumerate(batch.column(text).to_pylist()):
                starts = question_starts(body) if body else []
                for k, (number, start) in enumerate(starts):
                    end = starts[k + 1][1] if k + 1 < len(starts) else len(body)
                    at.append(i)
                    places.append(k)
                    numbers.append(number)
                    blocks.append(body[start:end].strip())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), pa.array(places, pa.int32()), pa.array(numbers, pa.int32()), pa.array(blocks, pa.string())], [*keys, "position", "question_number", "block"])

    return docs.select(*keys, text).mapInArrow(run, f"{kinds}, position int, question_number int, block string")


# what a block holds


def option_text(x: Column) -> Column:
    """An option without what runs into it: directives, labels, codes, watermarks, a second script."""
    for pattern in OPTION_ENDS:
        x = strip(F.regexp_replace(x, pattern, ""))
    return x


def _labelled(rest: Column, pattern: str, labels: str) -> Column:
    """The first filled option of each of the four labels."""
    rest = F.concat(F.lit("\n"), rest)
    found = F.zip_with(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)), F.regexp_extract_all(rest, F.lit(pattern), F.lit(2)), lambda k, v: F.struct((F.instr(F.lit(labels), F.upper(k)) - 1).alias("i"), option_text(strip(v)).alias("v")))
    none = F.array_repeat(F.lit(None).cast("string"), 4)
    return F.aggregate(found, none, lambda acc, e: F.transform(acc, lambda x, i: F.when(x.isNull() & (i == e["i"]) & (e["v"] != ""), e["v"]).otherwise(x)))


def _listed(rest: Column) -> Column:
    """The first four different lines that are no part of the answer sheet."""
    lines = F.transform(F.split(rest, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"), strip)
    lines = F.transform(F.filter(lines, lambda x: (x != "") & ~x.rlike(SHEET_NUMBER) & ~x.rlike(SHEET_LINE) & ~x.rlike(BARE_NUMBER)), collapse)
    none = F.array().cast("array<string>")
    kept = F.aggregate(lines, none, lambda acc, x: F.when((F.size(acc) < 4) & ~F.exists(acc, lambda y: F.lower(y) == F.lower(x)), F.array_append(acc, x)).otherwise(acc))
    return F.transform(F.concat(kept, F.array_repeat(F.lit(None).cast("string"), 4)), option_text)


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each computed once: filters above don't repeat them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def question_rows(blocks: DataFrame) -> DataFrame:
    """blocks with the fields of a question and its layout: numeric options (statements A to D before them belong to the stem),
    letters, lines under a heading, or none."""
    cuts = _once(blocks, _numeric=F.split("block", NUMERIC_CUT, 2), _letters=F.split("block", ALPHA_CUT, 2), _lines=F.split("block", HEADER_CUT, 2))
    way = F.when(F.size("_numeric") > 1, "numeric").when(F.size("_letters") > 1, "letters").when(F.size("_lines") > 1, "lines").otherwise("none")
    cuts = _once(cuts, layout=way, _cut=F.when(F.size("_numeric") > 1, F.col("_numeric")).when(F.size("_letters") > 1, F.col("_letters")).otherwise(F.col("_lines")))
    text, rest, layout = strip(F.col("_cut")[0]), F.get("_cut", F.lit(1)), F.col("layout")
    for pattern, other in STEM:
        text = strip(F.regexp_replace(text, pattern, other))
    options = F.when(layout == "numeric", _labelled(rest, NUMERIC_OPTION, "1234")).when(layout == "letters", _labelled(rest, ALPHA_OPTION, "ABCD")).when(layout == "lines", _listed(rest))
    letter = F.upper(F.nullif(F.regexp_extract("block", ALPHA_ANSWER, 1), F.lit("")))
    number = F.translate(F.nullif(F.regexp_extract("block", NUMERIC_ANSWER, 1), F.lit("")), "1234", "ABCD")
    out = _once(cuts, question_text=collapse(text), _options=options, correct_answer=F.when(layout == "numeric", F.coalesce(number, letter)).otherwise(letter))
    out = _once(out, **{o: F.coalesce(F.get("_options", F.lit(i)), F.lit("")) for i, o in enumerate(Q.OPTIONS)}, _picture=F.col("question_text").rlike(PICTURE))
    return out.withColumn("needs_review", (filled(*Q.OPTIONS) < 4) | F.col("_picture")).drop("_numeric", "_letters", "_lines", "_cut", "_options", "_picture")


def best_by_number(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows of one number that with most options and text, the first of equal ones."""
    worth = filled(*Q.OPTIONS) * OPTION_WORTH + F.length(strip("question_text"))
    return winners(rows.withColumn("_worth", worth), [*keys, "question_number"], [F.desc("_worth"), F.asc("position")]).drop("_worth")


def parsed_questions(docs: DataFrame, keys: list[str], pages: str) -> DataFrame:
    """keys, question_number, question_text, option_a to option_d, correct_answer, needs_review, layout of the questions in each
    document (X23).  pages: an array of page texts; null pages and empty ones hold nothing, documents without questions give
    no rows, keys stay as they are (repeated keys share their numbers).

    A question has a stem of over LEAST_STEM characters and an option at least.  Instructions are dropped before the winner of
    each number is chosen, stems that are only an answer after it.
    """
    rows = question_rows(question_blocks(docs.select(*keys, text_layer(F.col(pages)).alias("_text")), keys, "_text"))
    n = filled(*Q.OPTIONS)
    rows = rows.where((F.length("question_text") > LEAST_STEM) & (n >= 1)).where(~Q.instruction_like("question_text", n))
    return best_by_number(rows, keys).where(~answer_fragment("question_text")).select(*keys, *FIELDS, "layout")


# match tables

PROMPT = r"(?iUd)\b(?:match\s+the\s+following|match\s+list\s+i\s+with\s+list\s+ii|list\s*i\b.*\blist\s*ii\b)\b"
ABOUT = r"(?iU)list\s*i\b|word\b|book\b|writer\b|meaning\b"
HEADED_PROMPT = r"(?iUd)\b(?:match\s+the\s+following|match\s+the\s+columns?|match\s+list|match\s+column|match\s+list\s*[-–]?\s*i\s+with\s+list\s*[-–]?\s*ii|list\s*[-–]?\s*i\b.*\blist\s*[-–]?\s*ii\b|column\s+[iI]+\s+(?:and|with|&)\s+column\s+[iI]+)\b"
TABLE_END = re.compile(r"^\s*(?:choose|select)\s+the\s+correct|^\s*[A-D]\s*[-:]\s*[IVX\d]|^\s*\([1-4]\)\s*[A-D]-", re.IGNORECASE)
HEADED_END = re.compile(r"^\s*(?:choose|select)\s+the\s+correct|^\s*[A-D]\s*[\)\.]\s*[A-D1-9I][-–]\d|^\s*\([1-4]\)\s*[A-D]-", re.IGNORECASE)
LETTER_KEY = re.compile(r"([A-D])\.\s*(.+)", re.IGNORECASE)
NUMBER_KEY = re.compile(r"(\d+|[IVXLCDM]+)\.\s*(.+)", re.IGNORECASE)
TWO_ROWS = re.compile(r"(.+?)\s+(\d+|[IVXLCDM]+)\.\s*(.+)", re.IGNORECASE)
ROW_AND_KEY = re.compile(r"(.+?)\s+(\d+|[IVXLCDM]+)\.", re.IGNORECASE)
WIDE_ROWS = re.compile(r"([A-D])\.\s*(.+?)\s{2,}(\d+|[IVXLCDM]+)\.\s*(.+)", re.IGNORECASE)
HEADED_ROWS = re.compile(r"([A-D])\.\s*(.+?)\s{2,}([1-9])\.\s*(.+)")
HEADED_LEFT = re.compile(r"([A-D]|[Ii]{1,4}[Vv]?[Ii]*)[.)]\s*(.+)")
HEADED_RIGHT = re.compile(r"([1-9]|[a-d]|[ivxlIVXL]{1,4})[.)]\s*(.+)")
FIRST_COLUMN = re.compile(r"(?:column|list)\s*[i1]", re.IGNORECASE)
SECOND_COLUMN = re.compile(r"(?:column|list)\s*(?:ii|2)", re.IGNORECASE)
INTRO = "Match the following:"
ROMAN_DIGITS = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
ROMAN_KEYS = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
LAST_KEY = 99


def _lines(text: str, end: re.Pattern):
    for line in text.replace("\t", "    ").splitlines():
        line = line.strip()
        if line and end.search(line):
            return
        if line:
            yield line


def table_entries(text: str) -> list[tuple[str, str, str]]:
    """(side, key, text) of the lines of a table whose left keys are letters and whose right keys are numbers or roman.  A line may
    hold both; a right key at the end of a line takes the next line in, whose own right key holds if it has one."""
    out, waiting = [], None
    for line in _lines(text, TABLE_END):
        left, right = LETTER_KEY.fullmatch(line), NUMBER_KEY.fullmatch(line)
        if waiting is not None:
            out.append(("right", *right.groups()) if right else ("right", waiting, line))
            waiting = None
        elif wide := WIDE_ROWS.fullmatch(line):
            out += [("left", wide[1].upper(), wide[2].strip()), ("right", wide[3], wide[4].strip())]
        elif left and (only := ROW_AND_KEY.fullmatch(left[2])):
            out.append(("left", left[1].upper(), only[1].strip()))
            waiting = only[2]
        elif left and (two := TWO_ROWS.fullmatch(left[2])):
            out += [("left", left[1].upper(), two[1].strip()), ("right", two[2], two[3].strip())]
        elif left:
            out.append(("left", left[1].upper(), left[2].strip()))
        elif right:
            out.append(("right", right[1], right[2].strip()))
        else:
            out.append(("intro", "", line))
    return out


def headed_entries(text: str) -> list[tuple[str, str, str]]:
    """The same for tables under headings: a heading or the first entry says which side follows; roman keys may stand on
    the left, letters and small roman on the right."""
    out, side = [], None
    for line in _lines(text, HEADED_END):
        if FIRST_COLUMN.fullmatch(line):
            side = "left"
        elif SECOND_COLUMN.fullmatch(line):
            side = "right"
        elif both := HEADED_ROWS.fullmatch(line):
            out += [("left", both[1], both[2].strip()), ("right", both[3], both[4].strip())]
        elif side != "right" and (left := HEADED_LEFT.fullmatch(line)):
            out.append(("left", left[1].upper(), left[2].strip()))
            side = side or "left"
        elif right := HEADED_RIGHT.fullmatch(line):
            out.append(("right", right[1].lower(), right[2].strip()))
            side = side or "right"
        else:
            out.append(("intro", "", line))
    return out


def roman(key: Column) -> Column:
    """The value of a roman number: digits before larger ones are taken away."""
    digits = F.transform(F.split(F.upper(key), ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ROMAN_DIGITS.items() for x in kv)), c), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    return F.aggregate(F.reverse(digits), start, lambda acc, d: F.struct((acc["total"] + F.when(d < acc["last"], -d).otherwise(d)).alias("total"), d.alias("last")), lambda acc: acc["total"])


def _rank(key: Column, headed: bool, left: bool) -> Column:
    """What the entries of a side are sorted by: the letter, the number or the roman number.  Under headings roman keys on the
    left have no order of their own and stay as they stand."""
    number = key.try_cast("decimal(38,0)")
    if headed:
        known = F.try_element_at(F.create_map(*(F.lit(x) for kv in ROMAN_KEYS.items() for x in kv)), F.lower(key))
        letter = F.when(F.lower(key).rlike("^[a-z]$"), F.ascii(F.lower(key)) - F.ascii(F.lit("a")))
        return F.coalesce(*([] if left else [known]), letter, number, F.lit(LAST_KEY)).cast("decimal(38,0)")
    return F.ascii(key).cast("decimal(38,0)") if left else F.coalesce(F.when(key.rlike(r"^\d+$"), number), roman(key).cast("decimal(38,0)"))


def match_tables(rows: DataFrame, keys: list[str], text: str = "question_text", headed: bool = False) -> DataFrame:
    """keys, intro, col1, col2, payload of the rows whose text holds a table of two columns at least two long (X28); the columns are
    sorted by their keys, equal keys stay in the order of the lines, and need not be of one length.  Rows that already have a
    payload, no prompt (where unheaded: nor a word of what is matched), or less than two columns are left out, null and empty
    texts with them."""
    body = F.col(text)
    due = body.isNotNull() & (F.instr(body, Q.MATCH_MARK) == 0) & (body.rlike(HEADED_PROMPT) if headed else body.rlike(PROMPT) | body.rlike(ABOUT))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    scan = headed_entries if headed else table_entries

    def run(batches):
        kind = pa.list_(pa.struct([("side", pa.string()), ("key", pa.string()), ("text", pa.string())]))
        for batch in batches:
            found = [[{"side": s, "key": k, "text": x} for s, k, x in scan(body)] for body in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, kind)], [*keys, "_entries"])

    out = rows.where(due).select(*keys, body.alias("_text")).mapInArrow(run, f"{kinds}, _entries array<struct<side:string,key:string,text:string>>")
    side = lambda x: F.filter("_entries", lambda e: e["side"] == x)
    ordered = lambda x: F.transform(F.array_sort(F.transform(side(x), lambda e, i: F.struct(_rank(e["key"], headed, x == "left").alias("rank"), i.alias("i"), e["text"].alias("text")))), lambda e: e["text"])
    intro = F.array_join(F.transform(side("intro"), lambda e: e["text"]), "\n")
    out = out.select(*keys, F.when(intro == "", INTRO).otherwise(intro).alias("intro"), ordered("left").alias("col1"), ordered("right").alias("col2")).where((F.size("col1") >= 2) & (F.size("col2") >= 2))
    return out.withColumn("payload", payload("intro", "col1", "col2"))


def payload(intro, left, right) -> Column:
    """A stem with its two columns behind the mark, as JSON."""
    quoted = lambda c: F.array_join(F.transform(c, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^.(.*).$", 1)), ", ")
    return F.concat(intro, F.lit(f'\n\n{Q.MATCH_MARK}{{"col1": ['), quoted(left), F.lit('], "col2": ['), quoted(right), F.lit("]}"))


INLINE_ROW = r"(?imUd)^\s*(?:\d+|[A-D])\.\s*(.+?)\s{2,}(?:\d+|[A-D])\.\s*(.+?)\s*$"
INLINE_LINE = r"(?iUd)^(?:\d+|[A-D])\.\s*.+?\s{2,}(?:\d+|[A-D])\.\s*.+$"


def with_match_payload(rows: DataFrame, key: str = "id") -> DataFrame:
    """rows (key, question_text, question_type, match_left, match_right) with the payload put into question_text and question_type
    set: from the given columns, else from rows that hold both sides in one line, else from a table under headings; the rest
    keep their text, and their type where it is Match, else none.  Null keys have no table recovered."""
    named = F.lower(strip("question_type")) == "match"
    filled_in = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), strip), lambda x: x != "")
    text = F.coalesce("question_text", F.lit(""))
    given = named & (F.size(filled_in("match_left")) >= 2) & (F.size(filled_in("match_right")) >= 2)
    side = lambda i: F.filter(F.transform(F.regexp_extract_all(text, F.lit(INLINE_ROW), F.lit(i)), strip), lambda x: x != "")
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), strip)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(INLINE_LINE)), F.lit(True)).cast("int")
    above = F.array_join(F.filter(F.slice(lines, 1, F.when(first > 0, first - 1).otherwise(F.size(lines))), lambda x: x != ""), "\n")
    inline = named & (F.size(side(1)) >= 2) & (F.size(side(2)) >= 2)
    made = match_tables(rows.where(~F.coalesce(given | inline, F.lit(False))).select(key, "question_text"), [key], headed=True).select(F.col(key).alias("_key"), F.col("payload").alias("_payload")).dropDuplicates(["_key"])
    found = F.when(given, payload(F.when(text == "", INTRO).otherwise(text), filled_in("match_left"), filled_in("match_right"))).when(inline, payload(F.when(above == "", INTRO).otherwise(above), side(1), side(2))).otherwise(F.col("_payload"))
    out = rows.join(made, F.col(key) == F.col("_key"), "left").withColumn("_found", found)
    return out.withColumns({"question_text": F.coalesce("_found", "question_text"), "question_type": F.when(F.col("_found").isNotNull() | named, "Match").otherwise("")}).drop("_key", "_payload", "_found")
