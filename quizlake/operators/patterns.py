"""Question patterns: tag, skill and confidence by a first-match cascade, then trap, style, reason and hint.

The cascades are tables of rules; `when` chains made from them are evaluated per row, without a shuffle.  A row needs
question_text, option_a to option_d, subject, topic and subtopic.  Nulls count as empty text.  A question that no rule
settles, and an empty one, has null in every result.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, collapse

OPTIONS = ("option_a", "option_b", "option_c", "option_d")
RESULTS = ("pattern_tag", "trap_tag", "skill_tag", "question_style", "pattern_confidence", "pattern_reason", "solve_hint", "pattern_source")

# The patterns that decide results.
PATTERN = {
    "match": r"(?is)__match__:|match\s+(?:the\s+)?following|match\s+(?:list|column)|list\s*[-–]?\s*i\b.*list\s*[-–]?\s*ii\b|column\s*[-–]?\s*i\b.*column\s*[-–]?\s*ii\b",
    "assertion": r"(?is)\bassertion\b.{0,180}\breason\b",
    "chronology": r"(?i)chronolog|arrange\s+(?:the\s+following\s+)?(?:events|sentences|statements|acts|states|items)|correct\s+(?:sequence|order)|logical\s+order|jumbled\s+order|meaningful\s+and\s+coherent\s+paragraph|ascending\s+order|descending\s+order",
    "jumble": r"(?i)para\s*jumbles?|jumbled\s+(?:order|sentences)|sentences?\s+of\s+a\s+paragraph|arrange\s+the\s+sentences|\blogical\s+order\b|meaningful\s+and\s+coherent\s+paragraph",
    "grammar": r"(?i)grammatical\s+error|grammatically\s+(?:correct|incorrect)|error\s+in\s+the\s+(?:given\s+)?sentence|sentence\s+(?:has|contains)\s+(?:an?\s+)?error|which\s+(?:part|portion)\s+of\s+the\s+sentence|sentence\s+correction|identify\s+the\s+error|spot\s+the\s+error",
    "blank": r"(?i)fill\s+in\s+the\s+blank|complete\s+the\s+(?:given\s+)?sentence|select\s+the\s+most\s+appropriate\s+(?:word|option)\s+to\s+fill",
    "vocabulary": r"(?i)synonym|antonym|idiom|phrase|one[- ]word\s+substitution|meaning\s+of\s+the\s+word|spelt\s+correctly|vocabulary",
    "language": r"(?i)\b(?:english|language|grammar|verbal\s+ability|comprehension|reading|writing|vocabulary|linguistics|general\s+english)\b",
    "coding": r"""(?i)code\s+language|coded\s+as|coding[- ]decoding|how\s+is\s+['"].+['"]\s+coded|decoded\s+as""",
    "ranking": r"(?i)\brank(?:ed|ing)?\b|secured\s+\d+(?:st|nd|rd|th)\s+rank|from\s+the\s+top|from\s+the\s+bottom|maximum\s+scorer|minimum\s+scorer|seating\s+arrangement|linear\s+arrangement|circular\s+arrangement|direction\s+sense|faces?\s+(?:north|south|east|west)|turns?\s+(?:left|right)\s+and\s+walks|how\s+far\s+(?:is|was)\s+(?:he|she|they)\s+from\s+the\s+(?:starting|initial)|walks?\s+\d+\s+(?:km|m|meters?)\s+(?:towards?|to\s+the)",
    "divisor": r"(?i)\b(?:gcd|hcf|lcm)\b|greatest\s+common\s+divisor|least\s+common\s+multiple",
    "arithmetic": r"(?i)\b(?:percentage|average|mixture|mensuration|discount|algebra|equation|remainder|divisibility)\b|ratio\s+and\s+proportion|find\s+the\s+ratio|calculate\s+the\s+ratio|profit\s+and\s+loss|simple\s+interest|compound\s+interest|time\s+and\s+work|time,\s*speed\s+and\s+distance|number\s+system",
    "data": r"(?i)\btable\b|bar\s+graph|pie\s+chart|line\s+graph|data\s+interpretation|following\s+data",
    "place": r"(?i)\bmap\b|located\s+in|which\s+(?:state|district|river|basin|location)|where\s+is|outfall|tributary|passes\s+through|flows\s+through",
    "date": r"(?i)in\s+which\s+year|which\s+year|year\s+was|completed\s+and\s+started|founded\s+in|established\s+in|\b(?:18|19|20)\d{2}\b",
    "year asked": r"(?i)in\s+which\s+year|which\s+year\b|year\s+was\b|in\s+the\s+year\b|set\s+up\s+in|when\s+was\b|when\s+did\b|year\s+of\s+(?:establishment|founding|formation|constitution)|founded\s+in|established\s+in",
    "recent": r"(?i)recently|economic\s+survey|budget|mou|scheme|mission|yojana|policy|index|ranking|award|current\s+affairs|released\s+by|launched\s+by|trophy|cup\b|tournament|championship|olympics|world\s+cup|player\s+of|man\s+of\s+the\s+match|won\s+the|winner\s+of|gold\s+medal|silver\s+medal|bronze\s+medal|\bicc\b|\bbcci\b|\bfifa\b|summit|g20\b|g7\b|saarc|asean|bilateral|defence\s+deal|trade\s+deal|accord|ceasefire",
    "who": r"(?i)^who\b",
    "census": r"(?i)sex\s+ratio|population\s+census|census\s+recorded|demographic\s+indicator|literacy\s+rate",
    "reckon": r"(?i)\b(?:find|calculate|compute|evaluate|solve|determine)\b|how\s+many|how\s+much",
    "article": r"(?i)\barticle\s+\d+[a-z]?\b|\bschedule\s+(?:\d+|[ivxlcdm]+)\b|\bsection\s+\d+[a-z]?\b|\bamendment\b|\bconstitutional\s+provision\b|\bpart\s+(?:\d+|[ivxlcdm]+)\b",
    "committee": r"(?i)\bcommittee\b|\bcommission\b|\breport\b|\brecommended\s+by\b|\bheaded\s+by\b|\bchair(?:man|person)?\b",
    "statement": r"(?i)consider\s+the\s+following\s+statements|which\s+of\s+the\s+following\s+statements\s+(?:is|are)|which\s+of\s+the\s+(?:statements?\s+)?above\s+(?:is|are)|(?:how\s+many|which)\s+of\s+the\s+(?:above\s+)?statements?\s+(?:is|are)\s+(?:correct|incorrect|true|false)|statements?\s+(?:\d+\s+and\s+\d+|given\s+above)\s+(?:is|are)\s+(?:correct|incorrect|true|false)",
    "reference": r"(?i)\bwith\s+reference\s+to\b|\bin\s+the\s+context\s+of\b",
    "direct": r"(?i)^(?:who|what|when|where|which|the\s+term|the\s+word|identify)\b|\brefers\s+to\b|\bknown\s+as\b|\bis\s+called\b|\bwas\s+founded\s+by\b|\bis\s+located\s+in\b",
    "comparison": r"(?i)\bcompare|difference\s+between|distinguish|unlike|whereas\b",
    "definition": r"(?i)\bmeans\b|\bdefined\s+as\b|\brefers\s+to\b|\bterm\b|\bcalled\b",
    "negation": r"(?i)\bnot\b|\bincorrect\b|\bfalse\b|\bwrong\b|\bdoes\s+not\b|\bexcept\b",
    "except": r"(?i)\bexcept\b|\ball\s+except\b",
    "double negation": r"(?i)\bnot\s+incorrect\b|\bnot\s+false\b|\bnot\s+untrue\b",
    "absolute": r"(?i)\b(always|never|only|all|must|solely|entirely|completely|none|absolute)\b",
    "all above": r"(?i)\ball\s+of\s+the\s+above\b|\bnone\s+of\s+the\s+above\b",
    "combination": r"(?i)\b(?:only\s+)?(?:i|ii|iii|iv|1|2|3|4)\s*(?:,|and|&|\+)\s*(?:i|ii|iii|iv|1|2|3|4)\b|\b\d+\s*[-–]\s*[a-d]\b",
}


class Tag(NamedTuple):
    """Holds if a pattern is found (with `also`, without `unless`) or the subject names a word; those in `section` count
    in language sections only."""

    tag: str
    skill: str
    confidence: int
    pattern: str
    whole: bool = False  # search the options too
    words: tuple[str, ...] = ()
    section: tuple[str, ...] = ()
    also: str = ""
    unless: str = ""
    most_words: int = 0


class Mark(NamedTuple):
    """Holds if the tag is one of `tags`, the trap one of `traps` and the pattern is found, as far as they are given."""

    name: str
    tags: tuple[str, ...] = ()
    pattern: str = ""
    whole: bool = False
    traps: tuple[str, ...] = ()


# Labels, confidences and their order.
TAGS = (
    Tag("match-the-following", "analysis", 96, "match", whole=True),
    Tag("assertion-reason", "analysis", 96, "assertion"),
    Tag("para-jumble", "sequencing", 96, "jumble", words=("para jumble",)),
    Tag("fill-in-the-blank", "language-usage", 88, "blank", section=("pattern",)),
    Tag("grammar-error-detection", "language-usage", 88, "grammar", words=("grammar",), section=("words",)),
    Tag("vocabulary-usage", "language-usage", 86, "vocabulary", words=("vocabulary",), section=("pattern", "words")),
    Tag("coding-decoding", "pattern-recognition", 94, "coding", words=("coding",)),
    Tag("ranking-order", "sequencing", 90, "ranking", words=("ranking",)),
    Tag("gcd-lcm-calculation", "calculation", 94, "divisor", whole=True),
    Tag("data-interpretation", "calculation", 88, "data", words=("data interpretation",)),
    Tag("factual-recall", "recall", 80, "census", unless="reckon"),
    Tag("arithmetic-calculation", "calculation", 82, "arithmetic", words=("quantitative", "arithmetic", "number system")),
    Tag("chronology", "sequencing", 94, "chronology"),
    Tag("date-event-recall", "recall", 88, "year asked"),
    Tag("article-provision", "recall", 90, "article"),
    Tag("committee-mapping", "mapping", 88, "committee"),
    Tag("statement-elimination", "elimination", 92, "statement", also="combination"),
    Tag("statement-based", "analysis", 92, "statement"),
    Tag("scheme-current-affairs", "recall", 80, "recent", whole=True, words=("current affairs",)),
    Tag("date-event-recall", "recall", 82, "date", unless="who"),
    Tag("map-location", "mapping", 78, "place", words=("geography", "rivers", "map")),
    Tag("concept-application", "application", 78, "reference"),
    Tag("elimination", "elimination", 76, "combination", whole=True),
    Tag("factual-recall", "recall", 74, "direct", most_words=18),
)
TRAPS = (
    Mark("close-dates", ("date-event-recall", "chronology"), "date", whole=True),
    Mark("code-pair-confusion", ("coding-decoding", "match-the-following")),
    Mark("formula-confusion", ("gcd-lcm-calculation", "arithmetic-calculation")),
    Mark("sequence-confusion", ("para-jumble", "chronology", "ranking-order")),
    Mark("tense-agreement", ("grammar-error-detection", "fill-in-the-blank")),
    Mark("double-negation", (), "double negation"),
    Mark("except-not", (), "except"),
    Mark("negation", (), "negation"),
    Mark("all-of-above", (), "all above", whole=True),
    Mark("absolute-wording", ("statement-based", "statement-elimination", "assertion-reason", "concept-application", "elimination"), "absolute"),
    Mark("partial-truth", ("statement-based",), "combination", whole=True),
)
NEGATIVE = ("negation", "except-not", "double-negation")
STYLES = (
    Mark("language", ("grammar-error-detection", "fill-in-the-blank", "para-jumble", "vocabulary-usage")),
    Mark("quantitative", ("gcd-lcm-calculation", "arithmetic-calculation", "data-interpretation")),
    Mark("reasoning", ("coding-decoding", "ranking-order")),
    Mark("indirect", traps=NEGATIVE),
    Mark("comparative", (), "comparison"),
    Mark("definitional", (), "definition"),
    Mark("analytical", ("statement-based", "assertion-reason", "chronology", "match-the-following", "elimination")),
    Mark("direct"),
)
# What a learner is told, by tag; then by trap.
REASON = {
    "statement-based": "The examiner is testing statement validation, not plain memory.",
    "assertion-reason": "The examiner is testing whether the reason correctly explains the assertion.",
    "chronology": "The examiner is testing sequence awareness across events, dates, or ordered ideas.",
    "match-the-following": "The examiner is testing pair mapping across two lists.",
    "article-provision": "The examiner is testing exact constitutional/legal provision recall.",
    "committee-mapping": "The examiner is testing committee, report, or recommendation mapping.",
    "statement-elimination": "The examiner is testing elimination across multiple statements and option codes.",
    "grammar-error-detection": "The examiner is testing whether you can spot a specific grammar fault.",
    "fill-in-the-blank": "The examiner is testing contextual grammar or vocabulary selection.",
    "para-jumble": "The examiner is testing sentence ordering and paragraph coherence.",
    "coding-decoding": "The examiner is testing symbol/code mapping from repeated clues.",
    "ranking-order": "The examiner is testing positional reasoning from changed rank directions.",
    "gcd-lcm-calculation": "The examiner is testing factorisation and GCD/LCM relationships.",
    "arithmetic-calculation": "The examiner is testing formula selection and calculation accuracy.",
    "data-interpretation": "The examiner is testing extraction of values from a data set.",
    "map-location": "The examiner is testing location, river, state, or map-linked recall.",
    "date-event-recall": "The examiner is testing exact date or year-event association.",
    "scheme-current-affairs": "The examiner is testing recent current-affairs recall — a policy, scheme, award, sports event, or diplomatic development.",
    "vocabulary-usage": "The examiner is testing word meaning, phrase usage, or spelling.",
    "concept-application": "The examiner is testing whether you can apply a concept to context.",
    "elimination": "The examiner is testing option elimination under close distractors.",
    "factual-recall": "The examiner is testing direct factual recall.",
}
HINT = {
    "statement-based": "Evaluate each statement independently, mark definitely true/false first, then eliminate option combinations.",
    "assertion-reason": "First judge Assertion and Reason separately, then check whether Reason explains Assertion.",
    "chronology": "Anchor one or two dates/events you know, then eliminate impossible sequences.",
    "match-the-following": "Lock the easiest pair first, then eliminate answer codes instead of solving every pair.",
    "article-provision": "Recall the exact Article/Section/Schedule and watch for swapped institutions or powers.",
    "committee-mapping": "Start from the committee/report you know best and use it to eliminate code options.",
    "statement-elimination": "Check each statement separately, then eliminate answer-code combinations.",
    "grammar-error-detection": "Scan subject-verb agreement, articles, tense, prepositions, and modifiers one by one.",
    "fill-in-the-blank": "Use the sentence clue and tense marker before checking the options.",
    "para-jumble": "Find the opening sentence, connect pronouns/linkers, then verify the final sequence.",
    "coding-decoding": "Compare repeated words across coded phrases and lock the common code first.",
    "ranking-order": "Draw top/bottom positions and convert ranks before calculating.",
    "gcd-lcm-calculation": "Prime-factorise first; use GCD for common factors and LCM for maximum powers.",
    "arithmetic-calculation": "Identify the exact formula type before substituting numbers.",
    "data-interpretation": "Read the labels/units first, then calculate only what the question asks.",
    "map-location": "Anchor the location with state/river/direction clues before choosing.",
    "date-event-recall": "Use known anchor years/events to eliminate close-date distractors.",
    "scheme-current-affairs": "Identify the who/what/year of the event, scheme, or award — then scan options for close-name or close-year distractors.",
    "vocabulary-usage": "Use context first; then eliminate options with the wrong tone or part of speech.",
    "concept-application": "Translate the example into the underlying rule before looking at options.",
    "elimination": "Remove clearly wrong options first; do not chase the perfect answer immediately.",
    "factual-recall": "Answer from memory, then verify no option is a close-name/date distractor.",
}
NEGATIVE_HINT = " Underline the negative wording before reading the options."
TRAP_HINT = {"absolute-wording": " Be suspicious of absolute words like only, all, always, and never.", "all-of-above": " Test each option independently before choosing all/none of the above.", "partial-truth": " Look for the one word that makes an otherwise correct statement wrong."} | dict.fromkeys(NEGATIVE, NEGATIVE_HINT)
ELIMINATION_HINT = " Use elimination before final selection."


def _first(rules, holds, value) -> Column:
    """The value of the first rule that holds, else null."""
    head, *rest = rules
    return reduce(lambda chain, r: chain.when(holds(r), value(r)), rest, F.when(holds(head), value(head)))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def classified(rows: DataFrame) -> DataFrame:
    """rows with the columns of RESULTS; columns of these names are replaced."""
    question, whole, about = F.col("_p.question"), F.col("_p.whole"), F.col("_p.about")

    def found(name: str, everywhere: bool) -> Column:
        return (whole if everywhere else question).rlike(PATTERN[name])

    def tagged(r: Tag) -> Column:
        sides = {"pattern": found(r.pattern, r.whole)}
        if r.also:
            sides["pattern"] &= found(r.also, True)
        if r.unless:
            sides["pattern"] &= ~found(r.unless, False)
        if r.most_words:
            sides["pattern"] |= F.size(F.split(question, " ")) <= r.most_words
        if r.words:
            sides["words"] = reduce(Column.__or__, (F.lower(about).contains(w) for w in r.words))
        for side in r.section:
            sides[side] &= about.rlike(PATTERN["language"])
        return reduce(Column.__or__, sides.values())

    def marked(r: Mark) -> Column:
        told = [F.col("_t.tag").isin(*r.tags)] if r.tags else []
        told += [F.coalesce(F.col("_trap").isin(*r.traps), F.lit(False))] if r.traps else []
        told += [found(r.pattern, r.whole)] if r.pattern else []
        return reduce(Column.__and__, told, F.col("_t").isNotNull())

    parts = [collapse(c) for c in ("question_text", *OPTIONS)]
    named = [F.coalesce(col(c), F.lit("")) for c in ("subject", "topic", "subtopic")]
    out = rows.withColumn("_p", F.struct(parts[0].alias("question"), F.concat_ws(" ", *parts).alias("whole"), F.concat_ws(" ", *named).alias("about")))
    out = out.withColumn("_t", F.when(question != "", _first(TAGS, tagged, lambda r: F.struct(F.lit(r.tag).alias("tag"), F.lit(r.skill).alias("skill"), F.lit(r.confidence).alias("confidence")))))
    out = out.withColumn("_trap", _first(TRAPS, marked, lambda r: F.lit(r.name)))
    tag = F.col("_t.tag")
    hint = F.concat(_lookup(HINT, tag), F.coalesce(_lookup(TRAP_HINT, F.coalesce("_trap", F.lit(""))), F.lit("")))
    late = (F.col("_t.skill") == "elimination") & ~F.lower(hint).contains("eliminate")
    values = (tag, F.col("_trap"), F.col("_t.skill"), _first(STYLES, marked, lambda r: F.lit(r.name)), F.col("_t.confidence"), _lookup(REASON, tag), F.when(late, F.concat(hint, F.lit(ELIMINATION_HINT))).otherwise(hint), F.when(tag.isNotNull(), F.lit("rules")))
    return out.withColumns(dict(zip(RESULTS, values, strict=True))).drop("_p", "_t", "_trap")
