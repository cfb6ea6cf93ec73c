"""Queries of question patterns; `documents` serve as a question bank, each text after one of ASKED (or none), so that every
rule is met.  The SQL's chains are made from the same fixed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import patterns as P
from .banks import BANK, bank
from .queries import query


ASKED = ("", "Match the following.", "Assertion: it rains. Reason: clouds.", "Arrange the sentences.", "Fill in the blank.", "Spot the error.", "Give a synonym.", "CAT is coded as DBU.", "Five steps from the top.", "The LCM of 4 and 6.", "Read the bar graph.", "The literacy rate rose.", "Compute the literacy rate by simple interest.", "The correct sequence, not 1857.", "In which year was it?", "Article 21 says all except:", "The committee is not incorrect.", "Consider the following statements 1 and 2.", "Consider the following statements, only these.", "A scheme launched by whom?", "The war of 1857.", "Who fought in 1857?", "Where is it? None of the above.", "With reference to rivers, compare.", "Only 1 and 3.", "Which term means that?")


def asked(spark, sf):
    texts = F.array(*map(F.lit, ASKED))
    return bank(spark, sf).withColumn("question_text", strip(F.concat_ws(" ", F.get(texts, (F.col("id") % len(ASKED)).cast("int")), "question_text"))).withColumn("topic", F.when(F.col("id") % 4 == 0, F.lit("English grammar")).otherwise(F.col("topic")))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found(name: str, whole: bool) -> str:
    return f"regexp_matches({'whole' if whole else 'question'}, {_text(P.PATTERN[name])})"


def _tagged(r: P.Tag) -> str:
    pattern = _found(r.pattern, r.whole)
    if r.also:
        pattern += " AND " + _found(r.also, True)
    if r.unless:
        pattern += " AND NOT " + _found(r.unless, False)
    if r.most_words:
        pattern += f" OR length(question) - length(replace(question, ' ', '')) < {r.most_words}"
    words = " OR ".join(f"contains(lower(about), {_text(w)})" for w in r.words) or "false"
    language = f"regexp_matches(about, {_text(P.PATTERN['language'])})"
    return " OR ".join(f"(({x}) AND {language if side in r.section else 'true'})" for side, x in (("pattern", pattern), ("words", words)))


def _marked(r: P.Mark) -> str:
    some = lambda column, names: [f"{column} IN ({', '.join(map(_text, names))})"] if names else []
    return " AND ".join(["k IS NOT NULL", *some("tag", r.tags), *some("trap", r.traps), *([_found(r.pattern, r.whole)] if r.pattern else [])])


def _chain(rules, holds, value) -> str:
    return "CASE " + " ".join(f"WHEN {holds(r)} THEN {value(k, r)}" for k, r in enumerate(rules)) + " END"


_CLEAN = "regexp_replace(regexp_replace(coalesce({}, ''), '[\\s\\x{{A0}}]+', ' ', 'g'), '^ | $', '', 'g')"
_ASKED = f"s AS (SELECT * REPLACE (concat_ws(' ', list_extract([{', '.join(map(_text, ASKED))}], (id % {len(ASKED)})::INT + 1), question_text) AS question_text, CASE WHEN id % 4 = 0 THEN 'English grammar' ELSE topic END AS topic) FROM q)"
_PARTS = [_CLEAN.format(c) for c in ("question_text", *P.OPTIONS)]
_TABLE = ", ".join(f"({k}, {_text(r.tag)}, {_text(r.skill)}, {r.confidence}, {_text(P.REASON[r.tag])}, {_text(P.HINT[r.tag])})" for k, r in enumerate(P.TAGS))
_TAIL = "CASE " + " ".join(f"WHEN trap = {_text(k)} THEN {_text(v)}" for k, v in P.TRAP_HINT.items()) + " ELSE '' END"


_MARKED_SQL = (
    f"p AS (SELECT id, {_PARTS[0]} AS question, concat_ws(' ', {', '.join(_PARTS)}) AS whole, concat_ws(' ', coalesce(subject, ''), coalesce(topic, ''), coalesce(subtopic, '')) AS about FROM s), "
    f"r AS (SELECT * FROM (VALUES {_TABLE}) AS v(n, tag, skill, confidence, reason, hint)), "
    f"k AS (SELECT *, CASE WHEN question <> '' THEN {_chain(P.TAGS, _tagged, lambda k, r: k)} END AS k FROM p), a AS (SELECT * FROM k LEFT JOIN r ON k.k = r.n), "
    f"b AS (SELECT *, {_chain(P.TRAPS, _marked, lambda k, r: _text(r.name))} AS trap FROM a), m AS (SELECT *, {_chain(P.STYLES, _marked, lambda k, r: _text(r.name))} AS style FROM b)"
)


@query(
    f"WITH {BANK}, {_ASKED}, p AS (SELECT id, {_PARTS[0]} AS question, concat_ws(' ', {', '.join(_PARTS)}) AS whole, concat_ws(' ', coalesce(subject, ''), coalesce(topic, ''), coalesce(subtopic, '')) AS about FROM s), "
    f"r AS (SELECT * FROM (VALUES {_TABLE}) AS v(n, tag, skill, confidence, reason, hint)), "
    f"k AS (SELECT *, CASE WHEN question <> '' THEN {_chain(P.TAGS, _tagged, lambda k, r: k)} END AS k FROM p), a AS (SELECT * FROM k LEFT JOIN r ON k.k = r.n), "
    f"b AS (SELECT *, {_chain(P.TRAPS, _marked, lambda k, r: _text(r.name))} AS trap FROM a), c AS (SELECT *, hint || {_TAIL} AS told FROM b) "
    f"SELECT id, tag AS pattern_tag, trap AS trap_tag, skill AS skill_tag, {_chain(P.STYLES, _marked, lambda k, r: _text(r.name))} AS question_style, confidence::INT AS pattern_confidence, reason AS pattern_reason, "
    f"told || CASE WHEN skill = 'elimination' AND NOT contains(lower(told), 'eliminate') THEN {_text(P.ELIMINATION_HINT)} ELSE '' END AS solve_hint, CASE WHEN tag IS NOT NULL THEN 'rules' END AS pattern_source FROM c",
    reserved=False,
)
def c17_c20_patterns(spark, sf):
    return P.classified(asked(spark, sf)).select("id", *P.RESULTS)


@query(f"WITH {BANK}, {_ASKED}, {_MARKED_SQL} SELECT tag AS pattern_tag, trap AS trap_tag, count(*) AS questions FROM m GROUP BY 1, 2", reserved=False)
def v4_tag_counts(spark, sf):
    """How many questions have each tag and trap, those that no rule settles included."""
    return P.classified(asked(spark, sf)).groupBy("pattern_tag", "trap_tag").agg(F.count("*").alias("questions"))
