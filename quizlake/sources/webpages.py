"""Question pages of a web site as rows (S7): JSON-LD first, then the page's script, then its text.

All of it is columns over (url, html): blocks are cut out by patterns and read as variants, so a malformed one is null and the
next way is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Patterns and limits.
LD_JSON = r"(?is)<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script\s*>"
UNREAD = r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
OPTION_LINE = r"(?d)^([A-D])[.)]\s+(.+)$"
NO_STEM = r"^[A-D][.)]\s"
SCRIPT_ANSWER = r"\"mcq\"\s*:\s*\{[^}]*\"q-\d+\"\s*:\s*(\d)\s*\}"
TOLD_ANSWER, TEXT_ANSWER = r"\(([A-D])\)", r"[Cc]orrect\s+(?:[Aa]nswer)?[:\s]+([A-D])\b"
LEAST_NAME, LEAST_LINE, LEAST_QUESTION, LEAST_TOPIC, HASHED = 10, 20, 10, 2, 120
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
LETTERS = "ABCD"


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else F.lit(None).cast("map<string,string>")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"), strip)


def _options(lines: Column) -> Column:
    """(i, text) of the lines that are options."""
    found = F.filter(lines, lambda x: x.rlike(OPTION_LINE))
    return F.transform(found, lambda x: F.struct((F.instr(F.lit(LETTERS), F.substring(x, 1, 1)) - 1).alias("i"), strip(F.regexp_extract(x, OPTION_LINE, 2)).alias("text")))


def _filled(options: Column) -> Column:
    return F.size(F.array_compact(options))


def visible_text(html: Column) -> Column:
    """What a reader sees, each piece on a line of its own; scripts, styles and comments are left out."""
    text = F.regexp_replace(F.regexp_replace(html, UNREAD, "\n"), r"<[^>]*>", "\n")
    for entity, sign in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def linked_data(html: Column) -> Column:
    """The objects among a page's JSON-LD blocks: types, name, text, answer, about; malformed blocks and lists are left out."""
    value = lambda v, path: F.try_variant_get(v, path, "string")
    parsed = F.transform(F.regexp_extract_all(html, F.lit(LD_JSON), F.lit(1)), F.try_parse_json)
    objects = F.filter(parsed, lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))
    types = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.coalesce(value(v, "$['@type']"), F.lit(""))))
    return F.transform(objects, lambda v: F.struct(types(v).alias("types"), F.try_variant_get(v, "$.mainEntity", "variant").isNotNull().alias("main"), strip(F.coalesce(value(v, "$.mainEntity.name"), F.lit(""))).alias("name"), strip(F.coalesce(value(v, "$.mainEntity.text"), F.lit(""))).alias("text"), F.coalesce(value(v, "$.mainEntity.acceptedAnswer.text"), F.lit("")).alias("answer"), F.coalesce(value(v, "$.about.name"), F.lit("")).alias("about")))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with these columns, each computed once: filters above don't repeat them."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def question_pages(pages: DataFrame, base: str, exams: dict[str, str] | None = None, subjects: dict[str, str] | None = None) -> DataFrame:
    """pages (url, html, ...) with the fields of the question on each; pages whose url isn't base/exam/year/subject/name, and those without a
    question, four options and an answer, are left out, as are null urls and pages."""
    parts = F.split(F.btrim(F.replace("url", F.lit(base), F.lit("")), F.lit("/")), "/")
    rows = pages.where(F.col("html").isNotNull()).withColumn("_parts", parts).where((F.size("_parts") == 4) & strip(F.col("_parts")[1]).try_cast("int").isNotNull())
    slug = lambda i: F.col("_parts")[i]
    subject = F.coalesce(F.try_element_at(_table(subjects or {}), slug(2)), F.initcap(F.replace(slug(2), F.lit("-"), F.lit(" "))))
    rows = _once(rows, exam_name=F.coalesce(F.try_element_at(_table(exams or {}), slug(0)), F.upper(slug(0))), exam_year=strip(slug(1)).try_cast("int"), subject=subject, _data=linked_data(F.col("html")))

    asked = F.filter("_data", lambda d: F.array_contains(d["types"], "QAPage") & d["main"])
    none = F.array_repeat(F.lit(None).cast("string"), 4)
    # a block fills the options as long as the ones before it left some out; its last line of a letter holds
    put = lambda acc, d: F.when(_filled(acc) < 4, F.transform(acc, lambda x, i: F.coalesce(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(_options(_lines(d["text"])), lambda o: o["i"] == i), lambda o: o["text"])), -1), x))).otherwise(acc)
    answers = F.filter(F.transform(asked, lambda d: F.regexp_extract(d["answer"], TOLD_ANSWER, 1)), lambda a: a != "")
    topics = F.transform(F.filter("_data", lambda d: F.exists(d["types"], lambda x: x.isin("Quiz", "LearningResource")) & (F.length(d["about"]) > LEAST_TOPIC)), lambda d: d["about"])
    last = lambda xs: F.when(F.size(xs) > 0, F.element_at(xs, -1))
    rows = _once(rows, _name=last(F.transform(F.filter(asked, lambda d: F.length(d["name"]) > LEAST_NAME), lambda d: d["name"])), _opts=F.aggregate(asked, none, put), _told=F.get(answers, F.lit(0)), topic=F.coalesce(last(topics), F.col("subject")))

    number = F.nullif(F.regexp_extract("html", SCRIPT_ANSWER, 1), F.lit(""))
    scripted = F.when(F.col("_name").isNotNull() & number.isin(*"0123"), F.translate(number, "0123", LETTERS))
    whole = F.col("_name").isNotNull() & (_filled(F.col("_opts")) == 4) & F.coalesce("_told", scripted).isNotNull()
    rows = _once(rows, _answer=F.coalesce("_told", scripted), _text=F.when(~whole, visible_text(F.col("html"))))
    rows = _once(rows, _seen=F.when(F.col("_text").isNotNull(), _lines(F.col("_text"))))
    seen = F.coalesce("_seen", F.array().cast("array<string>"))
    first_line = F.get(F.filter(seen, lambda x: (F.length(x) > LEAST_LINE) & ~x.rlike(NO_STEM)), F.lit(0))
    listed = F.aggregate(_options(seen), none, lambda acc, o: F.transform(acc, lambda x, i: F.when(x.isNull() & (i == o["i"]), o["text"]).otherwise(x)))
    rows = _once(rows, question_text=F.coalesce("_name", first_line), _found=F.when(_filled(F.col("_opts")) == 4, F.col("_opts")).otherwise(listed), correct_answer=F.coalesce("_answer", F.nullif(F.regexp_extract(F.coalesce("_text", F.lit("")), TEXT_ANSWER, 1), F.lit(""))))
    rows = rows.where((F.length("question_text") >= LEAST_QUESTION) & (_filled(F.col("_found")) == 4) & F.col("correct_answer").isNotNull())
    said = strip(F.lower(F.concat("exam_name", F.lit("_"), F.col("exam_year").cast("string"), F.lit("_"), F.substring("question_text", 1, HASHED))))
    rows = rows.withColumns({f"option_{x.lower()}": F.col("_found")[i] for i, x in enumerate(LETTERS)} | {"question_hash": F.sha2(said.cast("binary"), 256), "source_pdf": F.col("url"), "difficulty": F.lit("Medium"), "question_type": F.lit("MCQ"), "is_active": F.lit(True)})
    return rows.drop("_parts", "_data", "_name", "_opts", "_told", "_answer", "_text", "_seen", "_found", "html")
