"""Canonical taxonomy: subject, topic family and subtopic family of a question, from its raw labels.

The rules are tables (taxonomy_tables.py) tried in order; each result is one `when` chain over columns, without a shuffle.
Subject feeds topic, topic feeds subtopic.  Null labels count as empty ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, or_generic, strip
from . import taxonomy_tables as T

CANONICAL = ("canonical_subject", "canonical_topic_family", "canonical_subtopic_family")
#: Subjects that no rule but an anchor or a rescue moves, and old names.
STABLE = ("History", "Current Affairs", "English Language", "Logical Reasoning", "Quantitative Aptitude", "Polity", "Science & Technology", "Environment")
RENAMED = {
    "Telangana Specific": "History", "Telangana History": "History", "Telangana Culture": "History", "General Knowledge": "General Awareness", "General": "General Awareness",
    "Unclassified": "General Awareness", "General Science": "Science & Technology", "Post-Independence India": "History", "Medieval History": "History", "Ancient History": "History", "Modern History": "History",
    "World History": "History", "Computer Knowledge": "Science & Technology", "Computer Science": "Science & Technology", "International Relations": "Current Affairs", "Mathematics": "Quantitative Aptitude", "Art & Culture": "History",
}
IN_ORBIT = r"\bspace|isro|nasa|satellite|rocket|chandrayaan|mangalyaan|gaganyaan\b"
WORLD_BODIES = r"\bnato|united nations|world bank|imf|wto|international organizations?\b"
CULTURE, MOVEMENT, SCHEME = r"\bculture|festival|dance|art|literary|tribal culture\b", r"\bmovement\b", r"\bscheme|policy\b"


def has(x: Column, pattern: str) -> Column:
    """Whether a pattern is found, whatever the case, with Unicode's word ends and white space."""
    return x.rlike(f"(?iU){pattern}")


def loose(x) -> Column:
    """A label with its ordered replacements, white space collapsed before and after."""
    return strip(reduce(lambda out, rule: F.regexp_replace(out, f"(?iU){rule[0]}", rule[1]), T.LOOSE, strip(x)))


def label(x, fallback: Column) -> Column:
    """The loose label, or that of the fallback where the raw one says nothing."""
    return loose(F.when(F.lower(strip(x)).isin(*T.GENERIC), fallback).otherwise(strip(x)))


def _chain(cases, otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    (first, value), *rest = cases
    return reduce(lambda out, case: out.when(case[0], case[1]), rest, F.when(first, value)).otherwise(otherwise)


def _anchored(topic: Column, anchors: dict) -> list:
    return [(F.lower(topic).isin(*names), F.lit(subject)) for subject, names in anchors.items()]


def _industry(subtopic: Column) -> Column:
    return has(subtopic, T.INDUSTRY) & ~has(subtopic, T.INDUS_HISTORY)


def subject_family(subject, topic, subtopic) -> Column:
    """Anchors by topic, anchors within technical subjects, rescues, stable subjects, rules, old names."""
    s, t, u = col(subject), col(topic), col(subtopic)
    rescue, combined = F.concat_ws(" ", t, u), F.concat_ws(" ", s, t, u)
    technical = F.lower(s).isin(*(x.lower() for x in T.TECHNICAL_ANCHORS), "chemical engineering")
    cases = [
        *_anchored(t, T.TOPIC_ANCHORS),
        *((technical & hit, value) for hit, value in _anchored(t, T.TECHNICAL_ANCHORS)),
        (has(rescue, T.CRIMINAL_LAW) | has(rescue, T.POLITY_RESCUE), F.lit("Polity")),
        (_industry(u), F.lit("Economy")),
        (s.isin(*STABLE), s),
        *((has(combined, p), F.lit(name)) for p, name in T.SUBJECT_RULES),
        ((s == "Geography") & has(rescue, IN_ORBIT), F.lit("Science & Technology")),
        *((s == old, F.lit(new)) for old, new in RENAMED.items()),
    ]
    return _chain(cases, F.when(s == "", "General Awareness").otherwise(s))


def topic_family(subject, topic, subtopic) -> Column:
    """Fixed names, industry, space, the rescue of Polity, rules, then what is said of regions."""
    s, t, u = col(subject), col(topic), col(subtopic)
    rescue, combined = F.concat_ws(" ", t, u), F.concat_ws(" ", s, t, u)
    polity = (s == "Polity") & (has(rescue, T.CRIMINAL_LAW) | has(rescue, T.POLITY_RESCUE))
    told = (u != "") & ~F.lower(u).isin(*T.GENERIC) & (F.lower(u) != F.lower(t)) & (F.size(F.split(u, r"(?U)\s+")) <= 6) & ~u.rlike(r"[?.!:;]")
    culture, movement, scheme = has(combined, CULTURE), has(combined, MOVEMENT), has(combined, SCHEME)
    specific = t == "Telangana Specific"
    cases = [
        *((F.lower(t) == wrong, F.lit(right)) for wrong, right in T.TOPIC_FIXES.items()),
        (_industry(u), F.lit("Industries & Industrial Policy")),
        (has(combined, T.SPACE), F.lit("Space Technology")),
        (polity & has(rescue, T.CRIMINAL_LAW), F.lit("Criminal Laws")),
        (polity, F.when(told, u).otherwise("Constitutional Development")),
        (has(combined, T.MECHANICS), F.lit("Mechanics")),
        (has(combined, T.OPTICS), F.lit("Optics")),
        *((has(combined, p), F.lit(name)) for p, name in T.TOPIC_RULES),
        ((s == "International Relations") & has(combined, WORLD_BODIES), F.lit("International Organizations")),
        ((s == "Environment") & F.lower(combined).contains("pollution"), F.lit("Pollution")),
        (specific & (s == "History"), F.when(culture, "Telangana Culture").when(movement, "Telangana Movement").otherwise("Telangana History")),
        (specific & (s == "Economy"), F.when(scheme, "Government Schemes & Policies").otherwise("Telangana Economy")),
        (specific & (s == "Geography"), F.lit("Telangana Geography")),
        (specific & (s == "Polity"), F.lit("Telangana Polity")),
        ((s == "History") & has(combined, r"\btelangana|hyderabad\b"), F.when(movement, "Telangana Movement").when(culture, "Telangana Culture").otherwise("Telangana History")),
        ((s == "Economy") & has(combined, r"\btelangana\b"), F.when(scheme, "Government Schemes & Policies").otherwise("Telangana Economy")),
    ]
    return _chain(cases, F.when(t == "", "General").otherwise(t))


def subtopic_family(topic, subtopic) -> Column:
    """Laws and instruments by name within Mechanics and Optics; the topic where the subtopic repeats it or is empty."""
    t, u = col(topic), col(subtopic)
    combined = F.concat_ws(" ", t, u)
    cases = [
        (u == "", t),
        ((t == "Mechanics") & (has(combined, r"\bsecond law of motion|newton'?s second law\b") | has(combined, r"\bnewton'?s laws?|laws? of motion\b")), F.lit("Newton's Laws of Motion")),
        ((t == "Mechanics") & has(combined, r"\bmomentum|angular momentum\b"), F.lit("Momentum")),
        ((t == "Mechanics") & has(combined, r"\binertia|carrom|coin pile\b"), F.lit("Inertia")),
        ((t == "Mechanics") & has(combined, r"\bfriction\b"), F.lit("Friction")),
        ((t == "Optics") & has(combined, r"\btelescope|astronomical telescope\b"), F.lit("Optical Instruments")),
        ((t == "Optics") & has(combined, r"\blens|lenses|convergent|divergent|convex|concave\b"), F.lit("Lenses")),
        (F.lower(u) == F.lower(t), t),
    ]
    return _chain(cases, u)


def _derived(labels: DataFrame) -> DataFrame:
    """The canonical columns of label triples (_k0, _k1, _k2); each step is a projection, so that no chain is written twice."""
    general, knowledge, awareness = F.lit("General"), F.lit("General Knowledge"), F.lit("General Awareness")
    out = labels.withColumns({"_s": label("_k0", knowledge), "_t": label("_k1", general)})
    out = out.withColumn("_v", label("_k2", F.col("_t")))
    # labels that the replacements emptied fall back once more
    out = out.withColumns({"_s": label("_s", knowledge), "_t": label("_t", general)})
    out = out.withColumn("_u", label("_v", F.col("_t")))
    out = out.withColumn(CANONICAL[0], subject_family("_s", "_t", "_u"))
    out = out.withColumn("_s", label(CANONICAL[0], awareness))
    out = out.withColumn(CANONICAL[1], topic_family("_s", "_t", "_u"))
    out = out.withColumn("_t", label(CANONICAL[1], general))
    out = out.withColumn("_u", label("_v", F.col("_t")))
    return out.withColumn(CANONICAL[2], subtopic_family("_t", "_u"))


def with_taxonomy(df: DataFrame, subject: str = "subject", topic: str = "topic", subtopic: str = "subtopic") -> DataFrame:
    """df with the three canonical columns.  The rules run once for each different triple of labels, of which there are few
    beside the rows, and are joined back; the second grouping keeps filters on their results from being unrolled into them."""
    keys = {f"_k{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate((subject, topic, subtopic))}
    rows = df.withColumns(keys)
    told = _derived(rows.select(*keys).distinct()).groupBy(*keys).agg(*(F.any_value(c).alias(c) for c in CANONICAL))
    return rows.join(told, list(keys)).drop(*keys)


def applied(df: DataFrame) -> DataFrame:
    """subject, topic and subtopic replaced by the canonical ones; the raw ones stay in raw_* (those that are there already win)."""
    names = ("subject", "topic", "subtopic")
    raw = {f"raw_{c}": F.col(c) for c in names if f"raw_{c}" not in df.columns}
    out = with_taxonomy(df.withColumns(raw) if raw else df)
    return out.withColumns({c: F.col(k) for c, k in zip(names, CANONICAL, strict=True)})


def backfilled(df: DataFrame, key: str = "id") -> DataFrame:
    """Only the rows whose stored canonical values differ, with the values to write."""
    old = [F.col(c).alias(f"_old_{c}") if c in df.columns else F.lit(None).cast("string").alias(f"_old_{c}") for c in CANONICAL]
    out = with_taxonomy(df.select(*(c for c in df.columns if c not in CANONICAL), *old))
    differs = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in CANONICAL))
    return out.where(differs).select(key, *CANONICAL)


__all__ = ["CANONICAL", "applied", "backfilled", "has", "label", "loose", "or_generic", "subject_family", "subtopic_family", "topic_family", "with_taxonomy"]
