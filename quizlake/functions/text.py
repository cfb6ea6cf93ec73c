"""Column functions: text, ratios, rounding, keys and dates.  Nulls count as empty text unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"^[\s ]+|[\s ]+$"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.coalesce(col(x), F.lit("")), EDGE, "")


def blank(x) -> Column:
    return strip(x) == ""


def collapse(x) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return strip(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[\s ]+", " "))


def paper_key(name, year) -> Column:
    return F.concat_ws("::", F.lower(collapse(name)), col(year).cast("string"))


def coded(x, codes: dict[str, str], empty: str = "unknown") -> Column:
    """A code by a literal map; an unknown value stays, an empty one becomes `empty`."""
    table = F.create_map(*(F.lit(v) for pair in codes.items() for v in pair))
    key = F.lower(strip(x))
    return F.when(key == "", F.lit(empty)).otherwise(F.coalesce(F.try_element_at(table, key), key))


def basename(x) -> Column:
    return F.substring_index(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\\", "/"), "/", -1)


def or_generic(x, fallback: str = "General", generic: tuple[str, ...] = ("", "general", "unclassified", "miscellaneous", "basics", "mixed")) -> Column:
    return F.when(F.lower(strip(x)).isin(*generic), F.lit(fallback)).otherwise(strip(x))


def matched(x, pattern: str) -> Column:
    """How many characters match a character class."""
    x = F.coalesce(col(x), F.lit(""))
    return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))


def regional_ratio(x) -> Column:
    """Devanagari and Telugu letters among all letters; 0 without letters."""
    letters = matched(x, r"\p{L}")
    return F.when(letters == 0, F.lit(0.0)).otherwise(matched(x, r"[\p{L}&&[ऀ-ॿఀ-౿]]") / letters)


def strip_regional(x) -> Column:
    """Without regional letters; blanks squeezed, empty lines dropped."""
    lines = F.split(F.regexp_replace(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"[\u0900-\u097F\u0C00-\u0C7F]", ""), r"[ \t]{2,}", " "), "\n")
    return F.array_join(F.filter(F.transform(lines, strip), lambda s: s != ""), "\n")


def filled(*options) -> Column:
    """How many of the options are not blank."""
    return sum(((~blank(o)).cast("int") for o in options), F.lit(0))


#: Printable characters that are no white space: no control, format, private, surrogate, unassigned or separator characters.
PRINTABLE = r"[^\p{C}\p{Z}]"


def garbled(x) -> Column:
    """More than 8 % of at least 8 printable characters, blanks not counted, lie in U+0080 to U+00FF."""
    n = matched(x, PRINTABLE)
    return (n >= 8) & (matched(x, r"[\u0080-ÿ&&[^\p{C}\p{Z}]]") > 0.08 * n)


def english(x) -> Column:
    """More than 30 % of the printable characters are ASCII and the text is not garbled."""
    n = matched(x, PRINTABLE)
    return (n > 0) & ~garbled(x) & (matched(x, r"[\x21-\x7E]") > 0.3 * n)


# Exams whose papers are trusted, and the scripts of te, hi, mr, ta, kn, ml, bn and gu.
TRUSTED_EXAMS = ("upsc", "cisf", "nda", "cds")
REGIONAL_SCRIPTS = r"[\u0900-\u097F\u0980-\u09FF\u0A80-\u0AFF\u0B80-\u0BFF\u0C00-\u0C7F\u0C80-\u0CFF\u0D00-\u0D7F&&\p{L}]"


def kept_as_english(x, exam_name=None) -> Column:
    """Whether a question stays in an English bank (F20): not garbled, and English or at least in none of the regional languages, which
    the script of most of its letters tells.  Of trusted exams all stay that have a text and are not garbled."""
    text = F.coalesce(col(x), F.lit(""))
    regional = 2 * matched(text, REGIONAL_SCRIPTS) > matched(text, r"\p{L}")
    kept = (text != "") & ~garbled(text) & (english(text) | ((matched(text, PRINTABLE) > 0) & ~regional))
    if exam_name is None:
        return kept
    trusted = F.lower(F.coalesce(col(exam_name), F.lit(""))).rlike("|".join(TRUSTED_EXAMS))
    return F.when(trusted, (text != "") & ~garbled(text)).otherwise(kept)


def tokens(x, stop: tuple[str, ...] = ("a", "an", "and", "for", "in", "of", "on", "or", "the", "to", "with")) -> Column:
    """The set of words of 2 characters and more without stop words, in order of first occurrence."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(x), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    return F.array_except(words, F.array(*(F.lit(w) for w in stop)))


def first_token(x) -> Column:
    """Commission by the first rule: the first word in capitals."""
    return F.upper(F.split_part(collapse(x), F.lit(" "), F.lit(1)))


def exam_type(x) -> Column:
    """The words after the first, or the whole name."""
    name = collapse(x)
    return F.when(F.instr(name, " ") > 0, F.regexp_replace(name, r"^\S+ ", "")).otherwise(name)


def commission(x, special: tuple[str, ...] = (), known: tuple[str, ...] = ()) -> Column:
    """Commission by the second rule: special prefixes, then known ones, then the first word, then GENERAL."""
    name = F.upper(collapse(x))
    out = F.when(name == "", F.lit("GENERAL")).otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    for prefix in reversed((*special, *known)):
        out = F.when(name.startswith(prefix.upper()), F.lit(prefix.upper())).otherwise(out)
    return out


def masked_name(uid) -> Column:
    """By the first four characters of the id; USER without one."""
    known = F.when(F.coalesce(col(uid), F.lit("")) == "", F.lit("user")).otherwise(col(uid))
    return F.concat(F.lit("Aspirant "), F.upper(F.substring(known, 1, 4)))


def percent(x, y, digits: int = 1) -> Column:
    """Half-even on the decimal text; 0 if y is 0."""
    return F.when(col(y) == 0, F.lit(0.0)).otherwise(F.bround(col(x) * 100.0 / col(y), digits))


def percent_half_up(x, y) -> Column:
    return F.when(col(y) == 0, F.lit(0)).otherwise(F.floor(col(x) * 100.0 / col(y) + 0.5)).cast("long")


def structural_threshold(n) -> Column:
    """At least 3 rows, or 5 %."""
    return F.greatest(F.lit(3), F.ceil(col(n) * 0.05)).cast("long")


def level(xp, steps: tuple[int, ...] = (0, 500, 1200, 2500, 5000, 10000)) -> Column:
    """The reference's steps; its last threshold (20,000) opens no level."""
    out = F.lit(1)
    for k, s in enumerate(steps):
        out = F.when(col(xp) >= s, F.lit(k + 1)).otherwise(out)
    return out


def window_start(kind: str, as_of) -> Column:
    return F.date_trunc({"monthly": "month", "weekly": "week"}[kind], F.lit(as_of).cast("timestamp"))


def timestamp_or(x, as_of) -> Column:
    """An ISO time, with Z or without, else as_of."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(strip(x), "Z$", "+00:00")), F.lit(as_of).cast("timestamp"))


def duration_text(seconds) -> Column:
    """Minutes and seconds from a minute on, below it seconds alone; halves of a second count up, nothing is below 0."""
    s = F.greatest(F.lit(0), F.floor(F.coalesce(col(seconds), F.lit(0)) + 0.5)).cast("long")
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def duration_seconds(x) -> Column:
    part = lambda unit: F.coalesce(F.regexp_extract(F.lower(F.coalesce(col(x), F.lit(""))), rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))
    return part("m") * 60 + part("s")


def effective_plan(plan, expires, as_of) -> Column:
    """The plan in small letters until it expires; one without an expiry holds, none is free."""
    name = F.lower(F.when(F.coalesce(col(plan), F.lit("")) == "", F.lit("free")).otherwise(col(plan)))
    return F.when(col(expires) < F.lit(as_of).cast("timestamp"), F.lit("free")).otherwise(name)


def content_hash(name, year, number, text, *options) -> Column:
    """SHA-256 of exam, year and number, or without a number of exam, year, text and the options as they are."""
    head = (F.lower(strip(name)), F.coalesce(col(year).cast("int").cast("string"), F.lit("")))
    numbered = F.concat_ws("|", *head, F.concat(F.lit("q"), col(number).cast("string")))
    free = F.concat_ws("|", *head, F.lower(strip(text)), *(F.coalesce(col(c), F.lit("")) for c in options))
    return F.sha2(F.when(col(number).isNotNull(), numbered).otherwise(free), 256)


def scope(raw) -> Column:
    """A list with commas as its different parts in capitals, in order, blank ones left out."""
    parts = F.transform(F.split(F.coalesce(col(raw), F.lit("")), ","), lambda x: F.upper(strip(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))
