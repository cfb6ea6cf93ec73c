"""Queries of the canonical taxonomy over labels dealt to the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalogue as G
from ..operators import taxonomy as C
from ..operators import taxonomy_tables as T
from .queries import query, t

#: Labels of the fixture; together they meet anchors, rescues, rules, regions and defaults.
SUBJECTS = ["History", "Polity", "Economy", "Geography", "General Knowledge", "", "Telangana Specific", "Law", "Civil Engineering", "International Relations", "Environment", "Mathematics", "Science & Technology", "  General  ", "Art & Culture", "Botany (old)", "General Science"]
TOPICS = ["Seating Arrangement", "Telangana Specific", "Parliament", "General", "Soil Science", "Criminal law & procedure", "Surveying & Mapping", "Space missions", "Diplomacy", "synergisms", "Rivers", "Awards & Records", "Hyderabad festivals", "tribes of india", "Basics", "Trade", "Domestic Affairs", "Optics", "History of Telangana (part 1)"]
SUBTOPICS = ["Industrial corridors", "Second law of motion", "Telangana movement", "", "Concave lenses", "World Bank reports", "Evidence Act", "Folk dance", "Telangana schemes", "Right to Information Act", "noise pollution", "overview", "Angular momentum", "Carrom coin pile", "Census", "Series", "A very long heading about court matters here: really", "mixed", "Satellite launch", "Telescope", "Introduction", "Art festivals", "Profit"]


def labels(spark, sf):
    pick = lambda values, k: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("doc_id") * k % len(values) + 1).cast("int"))
    return t(spark, sf, "documents").select(F.col("doc_id").alias("id"), pick(SUBJECTS, 1).alias("subject"), pick(TOPICS, 3).alias("topic"), pick(SUBTOPICS, 5).alias("subtopic"), F.col("source").alias("exam_name"), (F.col("doc_id") % 6 + 2015).cast("int").alias("exam_year"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def _loose(x: str) -> str:
    for p, new in T.LOOSE:
        x = f"regexp_replace({x}, {quoted(p)}, {quoted(new)}, 'gi')"
    return f"trim({x})"


def _label(x: str, fallback: str) -> str:
    return _loose(f"CASE WHEN lower(trim({x})) IN {_list(T.GENERIC)} THEN {fallback} ELSE trim({x}) END")


def _hit(x: str, p: str) -> str:
    return f"regexp_matches({x}, {quoted(p)}, 'i')"


_INDUSTRY = f"{_hit('u', T.INDUSTRY)} AND NOT {_hit('u', T.INDUS_HISTORY)}"
_RESCUE = f"({_hit('r', T.CRIMINAL_LAW)} OR {_hit('r', T.POLITY_RESCUE)})"
_ANCHORS = " ".join(f"WHEN lower(t) IN {_list(v)} THEN {quoted(k)}" for k, v in T.TOPIC_ANCHORS.items())
_TECHNICAL = " ".join(f"WHEN lower(s) IN {_list([*(x.lower() for x in T.TECHNICAL_ANCHORS), 'chemical engineering'])} AND lower(t) IN {_list(v)} THEN {quoted(k)}" for k, v in T.TECHNICAL_ANCHORS.items())
_RULED = lambda rules: " ".join(f"WHEN {_hit('a', p)} THEN {quoted(k)}" for p, k in rules)
_TELANGANA = "CASE WHEN {first} THEN '{x}' WHEN {second} THEN '{y}' ELSE 'Telangana History' END"
_CULTURE, _MOVEMENT, _SCHEME = _hit("a", C.CULTURE), _hit("a", C.MOVEMENT), _hit("a", C.SCHEME)
LABELS = f"l0 AS (SELECT doc_id AS id, [{', '.join(map(quoted, SUBJECTS))}][doc_id % {len(SUBJECTS)} + 1] AS s0, [{', '.join(map(quoted, TOPICS))}][doc_id * 3 % {len(TOPICS)} + 1] AS t0, [{', '.join(map(quoted, SUBTOPICS))}][doc_id * 5 % {len(SUBTOPICS)} + 1] AS u0, source AS exam_name, (doc_id % 6 + 2015)::INT AS exam_year FROM documents)"
TAXONOMY = f"""{LABELS}, l1 AS (SELECT *, {_label('s0', "'General Knowledge'")} AS s1, {_label('t0', "'General'")} AS t1 FROM l0), l2 AS (SELECT *, {_label('u0', 't1')} AS u1 FROM l1),
l3 AS (SELECT *, {_label('s1', "'General Knowledge'")} AS s, {_label('t1', "'General'")} AS t FROM l2), l4 AS (SELECT *, {_label('u1', 't')} AS u FROM l3), l5 AS (SELECT *, t || ' ' || u AS r, s || ' ' || t || ' ' || u AS a FROM l4),
c1 AS (SELECT *, CASE {_ANCHORS} {_TECHNICAL} WHEN {_RESCUE} THEN 'Polity' WHEN {_INDUSTRY} THEN 'Economy' WHEN s IN {_list(C.STABLE)} THEN s {_RULED(T.SUBJECT_RULES)}
WHEN s = 'Geography' AND {_hit('r', C.IN_ORBIT)} THEN 'Science & Technology' {' '.join(f'WHEN s = {quoted(k)} THEN {quoted(v)}' for k, v in C.RENAMED.items())} WHEN s = '' THEN 'General Awareness' ELSE s END AS canonical_subject FROM l5),
c2 AS (SELECT * REPLACE ({_label('canonical_subject', "'General Awareness'")} AS s, {_label('canonical_subject', "'General Awareness'")} || ' ' || t || ' ' || u AS a) FROM c1),
c3 AS (SELECT *, CASE {' '.join(f'WHEN lower(t) = {quoted(k)} THEN {quoted(v)}' for k, v in T.TOPIC_FIXES.items())} WHEN {_INDUSTRY} THEN 'Industries & Industrial Policy' WHEN {_hit('a', T.SPACE)} THEN 'Space Technology'
WHEN s = 'Polity' AND {_hit('r', T.CRIMINAL_LAW)} THEN 'Criminal Laws'
WHEN s = 'Polity' AND {_RESCUE} THEN CASE WHEN u <> '' AND lower(u) NOT IN {_list(T.GENERIC)} AND lower(u) <> lower(t) AND len(string_split_regex(u, '\\s+')) <= 6 AND NOT regexp_matches(u, '[?.!:;]') THEN u ELSE 'Constitutional Development' END
WHEN {_hit('a', T.MECHANICS)} THEN 'Mechanics' WHEN {_hit('a', T.OPTICS)} THEN 'Optics' {_RULED(T.TOPIC_RULES)}
WHEN s = 'International Relations' AND {_hit('a', C.WORLD_BODIES)} THEN 'International Organizations' WHEN s = 'Environment' AND contains(lower(a), 'pollution') THEN 'Pollution'
WHEN t = 'Telangana Specific' AND s = 'History' THEN {_TELANGANA.format(first=_CULTURE, x='Telangana Culture', second=_MOVEMENT, y='Telangana Movement')}
WHEN t = 'Telangana Specific' AND s = 'Economy' THEN CASE WHEN {_SCHEME} THEN 'Government Schemes & Policies' ELSE 'Telangana Economy' END
WHEN t = 'Telangana Specific' AND s = 'Geography' THEN 'Telangana Geography' WHEN t = 'Telangana Specific' AND s = 'Polity' THEN 'Telangana Polity'
WHEN s = 'History' AND {_hit('a', chr(92) + 'btelangana|hyderabad' + chr(92) + 'b')} THEN {_TELANGANA.format(first=_MOVEMENT, x='Telangana Movement', second=_CULTURE, y='Telangana Culture')}
WHEN s = 'Economy' AND {_hit('a', chr(92) + 'btelangana' + chr(92) + 'b')} THEN CASE WHEN {_SCHEME} THEN 'Government Schemes & Policies' ELSE 'Telangana Economy' END
WHEN t = '' THEN 'General' ELSE t END AS canonical_topic_family FROM c2),
c4 AS (SELECT * REPLACE ({_label('canonical_topic_family', "'General'")} AS t) FROM c3), c5 AS (SELECT * REPLACE ({_label('u1', 't')} AS u, t || ' ' || {_label('u1', 't')} AS a) FROM c4),
tax AS (SELECT *, CASE WHEN u = '' THEN t WHEN t = 'Mechanics' AND regexp_matches(a, '(?i)\\bsecond law of motion|newton''?s second law\\b|\\bnewton''?s laws?|laws? of motion\\b') THEN 'Newton''s Laws of Motion' WHEN t = 'Mechanics' AND regexp_matches(a, '(?i)\\bmomentum') THEN 'Momentum'
WHEN t = 'Mechanics' AND regexp_matches(a, '(?i)\\binertia|carrom|coin pile\\b') THEN 'Inertia' WHEN t = 'Mechanics' AND regexp_matches(a, '(?i)\\bfriction\\b') THEN 'Friction' WHEN t = 'Optics' AND regexp_matches(a, '(?i)\\btelescope') THEN 'Optical Instruments'
WHEN t = 'Optics' AND regexp_matches(a, '(?i)\\blens|convergent|divergent|convex|concave') THEN 'Lenses' WHEN lower(u) = lower(t) THEN t ELSE u END AS canonical_subtopic_family FROM c5)"""


@query(f"WITH {TAXONOMY} SELECT id, canonical_subject, canonical_topic_family, canonical_subtopic_family FROM tax")
def c12_c13_c14_taxonomy(spark, sf):
    return C.with_taxonomy(labels(spark, sf)).select("id", *C.CANONICAL)


@query(f"WITH {TAXONOMY} SELECT id, s0 AS raw_subject, t0 AS raw_topic, u0 AS raw_subtopic, canonical_subject AS subject, canonical_topic_family AS topic, canonical_subtopic_family AS subtopic FROM tax")
def c15_applied_taxonomy(spark, sf):
    return C.applied(labels(spark, sf)).select("id", "raw_subject", "raw_topic", "raw_subtopic", "subject", "topic", "subtopic")


@query(f"WITH {TAXONOMY} SELECT id, canonical_subject, canonical_topic_family, canonical_subtopic_family FROM tax WHERE canonical_subject <> s0 OR canonical_topic_family <> t0 OR canonical_subtopic_family <> u0")
def e9_backfilled_taxonomy(spark, sf):
    rows = labels(spark, sf).withColumns({k: F.col(c) for k, c in zip(C.CANONICAL, ("subject", "topic", "subtopic"), strict=True)})
    return C.backfilled(rows)


@query(f"WITH {LABELS} SELECT id, {_loose('t0')} AS loose, CASE WHEN lower(trim(s0)) IN {_list(T.GENERIC)} THEN 'General Knowledge' ELSE trim(s0) END AS bucket FROM l0")
def x5_x6_loose_labels(spark, sf):
    return labels(spark, sf).select("id", C.loose("topic").alias("loose"), X.or_generic("subject", "General Knowledge").alias("bucket"))


FEED = f"{TAXONOMY}, f AS (SELECT id, exam_name, exam_year, canonical_subject AS subject, canonical_topic_family AS topic, canonical_subtopic_family AS subtopic FROM tax)"


@query(f"WITH {FEED} SELECT subject, topic, subtopic, count(*) AS count, count(DISTINCT exam_year) AS year_count, max(exam_year) AS latest_year, arg_max(exam_name, (exam_year, id)) AS latest_exam FROM f GROUP BY GROUPING SETS ((subject), (subject, topic), (subject, topic, subtopic))")
def a4_feed_levels(spark, sf):
    return G.feed(C.applied(labels(spark, sf)))


@query(f"WITH {FEED} SELECT exam_name, count(*) AS count, count(DISTINCT exam_year) AS year_count, count(DISTINCT (subject, topic)) AS topic_count FROM f GROUP BY 1")
def a5_feed_exams(spark, sf):
    return G.feed_exams(C.applied(labels(spark, sf)))
