"""The editors' desk: states by the store's own SQL, repairs of labels, edits, manual rows, retagging, lists, and the client's
reduced taxonomy.

A job returns the rows to write; the caller decides where.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, col, or_generic, strip, structural_threshold
from . import identity as I
from . import learner as L
from . import quality as Q
from . import taxonomy as T
from .catalogue import active, natural, supported
from .publishing import STRUCTURAL_ISSUES, implies_other, repair_queue

EXAM = ["exam_name", "exam_year"]
META = ["id", "exam_name", "exam_year", "subject", "topic", "subtopic", "difficulty", "needs_review", "is_active", "paper_id", "question_number"]
# Labels, lists and patterns decide the results.
NO_SUBJECT, NO_TOPIC = ("", "Unclassified", "General Knowledge"), ("", "Unclassified", "General")
SUBJECTS = {"General Science": "Science & Technology", "Environment": "Environment & Ecology", "Mental Ability": "Logical Reasoning"}
VAGUE_TOPICS = ("General", "Matching", "Matching Pairs", "Match the Following", "Statement Analysis", "Statements Analysis", "Statements based", "Telangana Specific")
DEFAULTS = {"question_text": "New Blank Question", "option_a": "Option A", "option_b": "Option B", "option_c": "Option C", "option_d": "Option D", "correct_answer": "A", "subject": "General Knowledge", "topic": "General", "subtopic": "", "difficulty": "Medium", "question_type": "mcq", "concept": "", "passage": ""}
BELONGS = [
    (r"\bnewton'?s laws?|laws? of motion|momentum|angular momentum|inertia|friction|net force|applied force|balanced forces?|unbalanced forces?|acceleration|velocity|displacement|mass|projectile|work done|kinetic energy|potential energy|conservation of energy|power|carrom(?: striker)?|telescope|microscope|lens|mirror|optics|reflection of light|refraction of light|ray optics|light rays?|wave optics|electric current|voltage|resistance|magnet|atom|molecule|acid|base|chemical reaction|photosynthesis|respiration|cell division|genetics|thermodynamics\b", ("General Science", "Science & Technology")),
    (r"\bconstitution|fundamental rights|directive principles|judiciary|supreme court|high court|parliament|lok sabha|rajya sabha|preamble|president|prime minister|governor|constitutional amendment|article\s+\d+\b", ("Polity",)),
    (r"\bbharatiya nyaya sanhita|bharatiya nagarik suraksha sanhita|bharatiya sakshya adhiniyam|criminal laws?|criminal procedure|evidence act|legal terminology|legal definitions|legal reforms|electoral offences?\b", ("Polity",)),
    (r"\bgovernment of india act|reorganisation act|reorganization act|state reorganisation|state reorganization|concurrent list|union list|state list|ordinance|judgment|judgements|court|judiciary|parliament|waqf|workmen'?s compensation act|forest rights act|manual scavengers|transgender persons|disabilities act|government orders?|g\.o\.|go 610|committees? and commissions?|union territories|religious laws?/acts?|social legislation|legal principles|rights of persons with disabilities|official secrets act|right to information act|migrant workmen|personal data protection|laws and acts|acts and laws|acts and reforms|law enforcement initiatives|national security laws?|state formation|state reorganization acts?\b", ("Polity", "Current Affairs")),
    (r"\bgdp|gnp|inflation|repo rate|reverse repo|crr|slr|budget|fiscal deficit|monetary policy|national income|msme|industry|industrial|manufacturing|sez|special economic zone|poverty|unemployment|tax|banking|rbi\b", ("Economy",)),
    (r"\bindus|harappa|vedic|maurya|gupta|mughal|ashoka|buddh|jain|gandhi|gandhian|quit india|non-cooperation|civil disobedience|satavahana|kakatiya|history of telangana|telangana movement\b", ("History",)),
    (r"\bmonsoon|rainfall|river|tributary|basin|soil|plateau|mountain|delta|desert|cyclone|latitude|longitude|mineral resources|agro-climatic\b", ("Geography",)),
    (r"\bpollution|ecosystem|biodiversity|climate change|global warming|greenhouse|wildlife|endangered|conservation|ecology|forest cover|ozone layer\b", ("Environment",)),
    (r"\bunited nations|security council|imf|world bank|wto|nato|asean|brics|quad|bilateral relations|foreign policy|multilateral|geopolitics\b", ("International Relations",)),
    (r"\bseating arrangement|blood relation|syllogism|coding[- ]decoding|direction sense|analogy|series\b", ("Logical Reasoning", "Mental Ability")),
    (r"\btime and work|time,? speed and distance|profit and loss|simple interest|compound interest|ratio|proportion|percentage|average|permutation|combination|probability|number system\b", ("Quantitative Aptitude", "Mathematics")),
]
FILE_STOP = ("and", "the", "paper", "question", "questions", "exam", "general", "studies", "preliminary", "prelims", "prelims.", "prelims-", "prelims_", "prelims2023", "final", "key", "master", "set", "copy", "with", "for", "of", "i", "ii", "iii")
FILE_HINTS = {"combined geo-scientist": ["cgspe", "geo", "scientist"], "upsc cds": ["cdse", "cds"], "cisf": ["cisf"], "group 4": ["group4", "gp_iv", "paper_1_master", "group-4"], "group 3": ["group3", "gr3", "group-3"], "group 2": ["group2", "gr2", "group-2"], "dao": ["dao"], "aee": ["aee"], "eo": ["eo"], "tpbo": ["tpbo"], "librarian": ["librarian"], "fsi": ["fso"]}
LEAST_SCORE = 18
CLIENT_SUBJECTS = [
    (r"\bindus|harapp|vedic|maurya|gupta|mughal|buddh|jain|gandhi|gandhian|telangana movement|social reform|temples? and architecture|festivals? of telangana|art and culture\b", "History"),
    (r"\bindustr(y|ies)|industrial|msme|trade|gdp|inflation|budget|fiscal|monetary|policy resolution\b", "Economy"),
    (r"\bclimate|rainfall|river|tributary|soil|forest|geography|agro-climatic|range|locations?\b", "Geography"),
    (r"\bbiodiversity|ecosystem|pollution|wildlife|environment|industrial disasters?\b", "Environment"),
    (r"\bconstitution|fundamental rights|directive principles|judiciary|parliament|preamble\b", "Polity"),
]
CLIENT_CONCEPTS = [
    (r"\bbuddh(a|is|ism|ist|hist)\b", "Buddhism"),
    (r"\bjain(a|ism|ist)?\b", "Jainism"),
    (r"\bgandhi|gandhian|mahatma gandhi|non-cooperation|civil disobedience|quit india\b", "Gandhian Thought & Movements"),
    (r"\btelangana movement|formation of telangana|statehood movement\b", "Telangana Movement"),
    (r"\btelangana history|social history of telangana|ancient and medieval history of telangana\b", "Telangana History"),
    (r"\btelangana culture|arts and crafts|literary institutions|tribal culture|cultural aspects\b", "Telangana Culture"),
    (r"\bमौर?yan|ashoka|chandragupta maurya\b", "Mauryan Empire"),
    (r"\bmughal|akbar|jahangir|shah jahan|aurangzeb\b", "Mughal Empire"),
    (r"\bgupta\b", "Gupta Empire"),
    (r"\bvedic|rig ved|sam ved|yajur ved|atharva ved\b", "Vedic Period"),
    (r"\bindus|harapp(a|an)\b", "Indus Valley Civilization"),
    (r"\bconstitution|constituent assembly\b", "Constitutional Development"),
    (r"\bfundamental rights|article 14|article 19|article 21|article 32\b", "Fundamental Rights"),
    (r"\bdirective principles|dpsp\b", "Directive Principles of State Policy"),
    (r"\bfundamental duties\b", "Fundamental Duties"),
    (r"\bparliament|lok sabha|rajya sabha\b", "Parliament"),
    (r"\bjudiciary|supreme court|high court|judicial review\b", "Judiciary"),
    (r"\bpreamble\b", "Preamble"),
    (r"\bmonsoon|rainfall\b", "Monsoon & Rainfall"),
    (r"\briver|tributary|basin\b", "Rivers"),
    (r"\bsoil\b", "Soils"),
    (r"\bclimate change|global warming|greenhouse\b", "Climate Change"),
    (r"\bbiodiversity|iucn|red list|endangered|wildlife\b", "Biodiversity & Conservation"),
    (r"\becology|ecosystem|food chain|food web\b", "Ecology"),
    (r"\binflation|cpi|wpi\b", "Inflation"),
    (r"\bgdp|gnp|national income\b", "National Income"),
    (r"\bbudget|fiscal deficit|revenue deficit\b", "Budget & Fiscal Policy"),
    (r"\bmonetary policy|repo rate|reverse repo|crr|slr\b", "Monetary Policy"),
    (r"\bindustr(y|ies)|industrial corridors?|industrial policy|industrial production|industrial development|manufacturing|sez|special economic zone|msme\b", "Industries & Industrial Policy"),
    (r"\btelangana budget|state budgets?\b", "State Budget & Economy"),
    (r"\btelangana schemes?|government schemes?|state policies?|policy\b", "Government Schemes & Policies"),
    (r"\bseating arrangement|circular arrangement|linear arrangement|square arrangement\b", "Seating Arrangement"),
    (r"\bblood relation|family tree\b", "Blood Relations"),
    (r"\bsyllogism\b", "Syllogism"),
    (r"\bcoding|decoding\b", "Coding-Decoding"),
    (r"\bseries\b", "Series"),
    (r"\bdirection sense|direction\b", "Direction Sense"),
    (r"\btime,? speed|distance|relative speed|boats? and streams?\b", "Time, Speed and Distance"),
    (r"\btime and work|work and wages|pipes and cisterns\b", "Time and Work"),
    (r"\bprofit|loss|discount|marked price\b", "Profit and Loss"),
    (r"\bsimple interest|compound interest\b", "Interest"),
    (r"\bpercentage\b", "Percentages"),
    (r"\bratio|proportion|partnership\b", "Ratio and Proportion"),
]
GENERIC_BITS = ("introduction", "basics", "overview", "concept", "facts", "features", "principles", "provisions", "causes", "effects", "impact", "classification", "types", "examples", "applications", "important terms", "miscellaneous")
#: The client's word ends know ASCII letters only; Java's know others too, so they are spelt out.
WORD_END = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


# the state of rows


def stored_state(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    """rows with the state by the store's own, narrower rules: one issue code, inactive rows hidden first (C4); a row is explained
    if any explanation names it (J10).  Nulls count as empty."""
    known = explanations.select(F.col("question_id").alias("_q")).distinct().withColumn("_explained", F.lit(True))
    out = rows.join(known, F.col("id") == F.col("_q"), "left")
    x = lambda c: F.coalesce(F.col(c), F.lit(""))
    short, lacking = F.length(F.trim(x("question_text"))) < 15, reduce(lambda a, b: a | b, (x(o) == "" for o in Q.OPTIONS))
    wrong, review, off = ~F.upper(x("correct_answer")).isin(*Q.LETTERS), Q._yes("needs_review"), ~F.coalesce("is_active", F.lit(True))
    no_subject, no_topic, no_subtopic = x("subject").isin(*NO_SUBJECT), x("topic").isin(*NO_TOPIC), x("subtopic") == ""
    code = F.when(short, "short-or-empty-text").when(lacking, "incomplete-options").when(review, "answer-review").when(wrong, "invalid-answer")
    lost = reduce(lambda a, b: a + b, (F.when(c, n).otherwise(0) for c, n in ((short, 35), (lacking, 35), (wrong, 30), (review, 8), (no_subject, 8), (no_topic, 6), (no_subtopic, 3))))
    state = {
        "structural_status": F.when(short | lacking, "broken").otherwise("valid"),
        "answer_status": F.when(wrong, "invalid").when(review, "ai_inferred").otherwise("verified"),
        "explanation_status": F.when(F.col("_explained"), "generated").otherwise("missing"),
        "tagging_status": F.when(no_subject | no_topic, "weak").when(no_subtopic, "partial").otherwise("strong"),
        "review_required": off | short | lacking | wrong | review | no_subject | no_topic,
        "confidence_score": F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost)),
        "public_visibility": F.when(off, "hidden_admin").when(short | lacking, "hidden_structural").otherwise("visible"),
        "primary_issue_code": code,
        "issue_codes": F.array_compact(F.array(code)),
    }
    return out.withColumns(state).drop("_q", "_explained")


def bootstrapped(rows: DataFrame, jobs: DataFrame, papers: DataFrame) -> DataFrame:
    """First versions of papers for the exams and years of old rows and jobs that have none (A30).  The rows of an exam win over
    its jobs, whose paper has no questions."""
    count = lambda c: F.count_if(c)
    have = rows.groupBy(*EXAM).agg(F.max("source_pdf").alias("source_filename"), F.count("*").alias("question_count"), count(F.col("is_active")).alias("visible_question_count"), count(~F.col("is_active")).alias("hidden_question_count"), F.min("created_at").alias("created_at"))
    none = F.lit(0).cast("long")
    waiting = jobs.groupBy(*EXAM).agg(F.max("filename").alias("source_filename"), none.alias("question_count"), none.alias("visible_question_count"), none.alias("hidden_question_count"), F.min("created_at").alias("created_at"))
    same = (F.col("a.exam_name") == F.col("b.exam_name")) & F.col("a.exam_year").eqNullSafe(F.col("b.exam_year"))
    grouped = have.unionByName(waiting.alias("a").join(have.alias("b"), same, "left_anti"))
    first = papers.where("upload_version = 1").select(*EXAM)
    out = grouped.join(first, EXAM, "left_anti")
    status = F.when(F.col("hidden_question_count") > 0, "publishable_with_hidden_rows").when(F.col("question_count") > 0, "publishable").otherwise("draft")
    key = F.concat(F.lower(F.regexp_replace("exam_name", r"\s+", " ")), F.lit("::"), F.col("exam_year").cast("string"))
    return out.select(*EXAM, F.col("exam_name").alias("display_name"), key.alias("paper_key"), "source_filename", F.lit(1).alias("upload_version"), F.when(F.col("question_count") > 0, "ingested").otherwise("pending").alias("lifecycle_status"), status.alias("publish_status"), "question_count", "visible_question_count", "hidden_question_count", F.col("hidden_question_count").alias("structural_issue_count"), "created_at")


# labels


def client_subject(subject, topic, subtopic) -> Column:
    """The subject family of the client's reduced taxonomy, which is not the canonical one."""
    text = F.lower(F.concat_ws(" ", *(F.coalesce(col(c), F.lit("")) for c in (subject, topic, subtopic))))
    return T._chain([(text.rlike(p.replace(r"\b", WORD_END)), F.lit(v)) for p, v in CLIENT_SUBJECTS], or_generic(subject, "General Knowledge"))


def client_concept(subject, topic, subtopic) -> Column:
    """The concept family of the client's reduced taxonomy."""
    generic = F.lower(strip(subtopic)).isin("", "general", "unclassified", "miscellaneous", "basics", "mixed")
    topic = or_generic(topic)
    sub = F.when(generic, topic).otherwise(strip(subtopic))
    text = F.lower(F.concat_ws(" ", F.coalesce(col(subject), F.lit("")), topic, sub))
    a, b = F.lower(topic), F.lower(sub)
    plain = (a == b) | F.startswith(b, a) | F.startswith(a, b) | reduce(lambda x, y: x | y, (F.contains(b, F.lit(bit)) for bit in GENERIC_BITS))
    loose = F.regexp_replace(F.regexp_replace(topic, r"(?U)\s+", " "), r"(?U)\s*\([^)]*\)\s*", " ")
    loose = reduce(lambda x, v: F.regexp_replace(x, f"(?i){WORD_END}{v}{WORD_END}", v), ("State Specific", "Telangana Specific"), loose)
    return T._chain([(text.rlike(p.replace(r"\b", WORD_END)), F.lit(v)) for p, v in CLIENT_CONCEPTS], F.when(plain, topic).otherwise(strip(loose)))


def suspect() -> Column:
    """A row whose text speaks of a subject that it isn't filed under."""
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("question_text", *Q.OPTIONS, "subject", "topic", "subtopic")))
    return reduce(lambda a, b: a | b, (text.rlike(f"(?iU){p}") & ~strip("subject").isin(*allowed) for p, allowed in BELONGS))


def vague_topic() -> Column:
    """A row whose topic says how it is asked, not what of."""
    return F.coalesce(F.col("topic").isin(*VAGUE_TOPICS), F.lit(False))


def renamed_subjects(rows: DataFrame) -> DataFrame:
    """rows with three old subjects of active rows renamed."""
    table = F.create_map(*(F.lit(x) for pair in SUBJECTS.items() for x in pair))
    return rows.withColumn("subject", F.when(Q._yes("is_active"), F.coalesce(F.try_element_at(table, F.coalesce("subject", F.lit(""))), F.col("subject"))).otherwise(F.col("subject")))


def tag_candidates(rows: DataFrame, limit: int, exam: str | None = None, year: int | None = None, paper: str | None = None, since=None, force: bool = False) -> DataFrame:
    """The next `limit` rows to tag (F26): active ones without a tag (with force also tagged ones), not tagged since a run's
    start; practice rows first, then the surest, then by id."""
    out = rows.where(Q._yes("is_active"))
    if exam:
        out = out.where(F.contains(F.lower("exam_name"), F.lit(exam.lower())))
    for c, v in (("exam_year", year), ("paper_id", paper)):
        out = out.where(F.col(c) == v) if v else out
    if since is not None:
        out = out.where(F.col("pattern_tagged_at").isNull() | (F.col("pattern_tagged_at") < F.lit(since).cast("timestamp")))
    if not force:
        out = out.where(F.coalesce("pattern_tag", F.lit("")) == "")
    return out.orderBy(F.col("practice_ready").desc_nulls_first(), F.col("confidence_score").desc_nulls_first(), "id").limit(limit)


def retagged(rows: DataFrame, explanations: DataFrame, exam: str | None = None, year: int | None = None) -> DataFrame:
    """Canonical labels and the state anew, for one exam and year or for all in one plan."""
    out = rows.where(F.col("exam_name") == exam) if exam else rows
    out = out.where(F.col("exam_year") == year) if year else out
    return Q.with_quality(_explained(T.applied(out), explanations), "_known").drop("_known")


def _explained(rows: DataFrame, explanations: DataFrame) -> DataFrame:
    known = explanations.select(F.col("question_id").alias("id")).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, "id", "left")


# edits


def edited(rows: DataFrame, edits: DataFrame, explanations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edited rows with their state anew, and the explanations that stay (N9).  edits (id, patch map<string,string>), one for
    an id.  Labels that were sent make the canonical ones; a full, active row whose review is cleared is published; a changed
    answer takes the explanation away."""
    sent = edits.select("id", F.col("patch").alias("_patch"))
    stale = sent.where(F.arrays_overlap(F.map_keys("_patch"), F.array(*map(F.lit, ("correct_answer", "correct_answers", "answer_status")))))
    out = Q.patched(rows.join(sent, "id"), "_patch")
    said = {f"_l{i}": F.coalesce(F.try_element_at("_patch", F.lit(c)), F.lit("")) for i, c in enumerate(("subject", "topic", "subtopic"))}
    labelled = F.arrays_overlap(F.map_keys("_patch"), F.array(*map(F.lit, ("subject", "topic", "subtopic"))))
    kept = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string") for c in T.CANONICAL}
    out = T.with_taxonomy(out.select(*(c for c in out.columns if c not in T.CANONICAL), *(v.alias(f"_was_{c}") for c, v in kept.items())).withColumns(said), *said)
    out = out.withColumns({c: F.when(labelled, F.col(c)).otherwise(F.col(f"_was_{c}")) for c in T.CANONICAL})
    status = F.lower(strip("answer_status"))
    several = F.coalesce(F.size("correct_answers") >= 2, F.lit(False)) if "correct_answers" in rows.columns else F.lit(False)
    full = Q._yes("is_active") & ~Q._yes("needs_review") & (F.length(strip("question_text")) >= 15) & reduce(lambda a, b: a & b, (~blank(o) for o in Q.OPTIONS))
    done = full & (F.upper(strip("correct_answer")).isin(*Q.LETTERS) | (status == "deleted") | ((status == "multiple") & several))
    out = Q.with_quality(_explained(out.withColumns({"_done": done, "_status": status}), explanations), "_known")
    done = F.col("_done")
    trusted = {"structural_status": "valid", "public_visibility": "visible"}
    out = out.withColumns({
        **{c: F.when(done, v).otherwise(F.col(c)) for c, v in trusted.items()}, "review_required": ~done & F.col("review_required"),
        "answer_status": F.when(done & F.col("_status").isin("deleted", "multiple"), F.col("_status")).otherwise(F.col("answer_status")),
    })
    left = explanations.join(stale.select(F.col("id").alias("question_id")), "question_id", "left_anti")
    return out.drop("_patch", "_known", "_done", "_status", *said, *(f"_was_{c}" for c in T.CANONICAL)), left


def manual_rows(asked: DataFrame, as_of) -> DataFrame:
    """New rows from what was given of them, the rest by default, with their state (N10).  The hash holds the time and number."""
    given = lambda c: F.nullif(F.col(c), F.lit("")) if c in asked.columns else F.lit(None).cast("string")
    number = F.coalesce("question_number", F.lit(1))
    out = asked.select(
        F.coalesce("exam_name", F.lit("")).alias("exam_name"), F.coalesce("exam_year", F.lit(2024)).alias("exam_year"), number.alias("question_number"), *(F.coalesce(given(c), F.lit(v)).alias(c) for c, v in DEFAULTS.items()),
        F.lit(True).alias("is_active"), F.coalesce("needs_review", F.lit(True)).alias("needs_review"), F.concat_ws("_", F.lit("manual"), F.unix_timestamp(F.lit(as_of).cast("timestamp")).cast("string"), number.cast("string")).alias("question_hash"),
        *(F.lit(None).cast(k).alias(c) for c, k in (("answer_status", "string"), ("explanation_status", "string"), ("image_url", "string"), ("has_image", "boolean"))),
    )
    return Q.with_quality(out)


def stale_explanations(rows: DataFrame, explanations: DataFrame, exam: str | None = None) -> DataFrame:
    """Explanations of questions under review, to be deleted; their count is the dry run."""
    review = rows.where(Q._yes("needs_review"))
    review = review.where(F.col("exam_name") == exam) if exam else review
    return explanations.join(review.select(F.col("id").alias("question_id")), "question_id", "left_semi")


def known_columns(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Only what the table has columns for."""
    return supported(rows, table.columns)


def bookmarked(stored: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Bookmarks (uid, question_id, note, at) after additions, of which the newest holds, and removals."""
    key = ["uid", "question_id"]
    return I.upsert(stored, added, key, [F.desc("at"), F.asc("note")]).join(removed.select(*key), key, "left_anti")


def stats_saved(stored: DataFrame, sent: DataFrame, as_of) -> DataFrame:
    """The learners' stored statistics (uid, stats, updated_at) with those sent (uid, stats, at) in their place."""
    fresh = I.winners(sent, ["uid"], [F.desc("at"), F.desc("stats")]).select("uid", "stats", F.lit(as_of).cast("timestamp").alias("updated_at"))
    return I.upsert(stored, fresh, ["uid"], [F.desc("updated_at")])


def reviewed(stored: DataFrame, reviews: DataFrame) -> DataFrame:
    """The cards after one review each (uid, question_id, quality 0 to 5, on): stored cards go on from their state, new ones from
    the start (R5).  A batch with several reviews of a card is put in one after the other."""
    key = ["uid", "question_id"]
    was = stored.select(*key, F.col("interval_days").alias("_i"), F.col("ease").alias("_e"), F.col("repetitions").alias("_r"))
    state = F.struct(F.coalesce("_i", F.lit(1)).alias("interval_days"), F.coalesce("_e", F.lit(2.5)).cast("double").alias("ease"), F.coalesce("_r", F.lit(0)).alias("repetitions"))
    out = reviews.join(was, key, "left").withColumn("_s", state).withColumn("_n", L.sm2(F.col("_s"), F.col("quality")))
    out = out.select(*key, "_n.interval_days", "_n.ease", "_n.repetitions", F.date_add("on", F.col("_n.interval_days")).alias("due_date"), F.col("quality").alias("last_quality"))
    return I.upsert(stored, out, key, [F.desc("due_date")])


# papers


def synced(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """papers with counts and status of their rows anew (E2); a paper without rows is blocked and in processing.
    rows (paper_id, visible, structural)."""
    new = I.publish_state(rows).select("paper_id", F.col("total").alias("_n"), F.col("shown").alias("_v"), F.col("hidden").alias("_h"), F.col("structural").alias("_s"), F.col("status").alias("_p"), F.col("lifecycle").alias("_l"))
    out = papers.join(new, F.col("id") == F.col("paper_id"), "left")
    put = {"question_count": ("_n", 0), "visible_question_count": ("_v", 0), "hidden_question_count": ("_h", 0), "structural_issue_count": ("_s", 0), "publish_status": ("_p", "blocked"), "lifecycle_status": ("_l", "processing")}
    return out.withColumns({c: F.coalesce(F.col(k), F.lit(v)) for c, (k, v) in put.items()}).select(*dict.fromkeys((*papers.columns, *put)))


def published(rows: DataFrame) -> DataFrame:
    """Per exam and year the counts and the status that publishing sets, and whether it may be done (E5).  rows are those of the
    latest paper; inactive ones count but are not shown."""
    queue = repair_queue(rows).where("blocker = 'row'")
    doomed = queue.where("id IS NOT NULL").select("id").distinct().withColumn("_doomed", F.lit(True))
    out = rows.join(doomed, "id", "left").groupBy(*EXAM).agg(F.count("*").alias("question_count"), F.count_if(active()).alias("_live"), F.count_if(active() & F.col("_doomed").isNull()).alias("visible_question_count"))
    told = queue.groupBy(*EXAM).agg(F.count("*").alias("hidden_question_count"), F.count_if(F.col("issue").isin(*STRUCTURAL_ISSUES)).alias("_structural"))
    out = out.join(told, EXAM, "left").na.fill(0, ["hidden_question_count", "_structural"])
    status = F.when(F.col("_structural") >= structural_threshold("_live"), "reupload_needed").when(F.col("_live") == 0, "blocked").when(F.col("hidden_question_count") > 0, "publishable_with_hidden_rows").otherwise("publishable")
    out = out.withColumn("publish_status", status).drop("_live", "_structural")
    return out.withColumn("published", F.col("publish_status").isin("publishable", "publishable_with_hidden_rows"))


def with_reports(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Ended jobs with the gate's report on their exam and year, or an empty one (J13); other jobs have none."""
    told = reports.select(*EXAM, F.struct("publishable", "question_count", "reasons").alias("_report"))
    ended = F.coalesce(F.col("exam_name") != "", F.lit(False)) & (F.coalesce("exam_year", F.lit(0)) != 0) & F.col("status").isin("completed", "failed", "archived")
    empty = F.struct(F.lit(False).alias("publishable"), F.lit(0).cast("long").alias("question_count"), F.array().cast("array<string>").alias("reasons"))
    return jobs.join(told, EXAM, "left").withColumn("quality_report", F.when(F.coalesce(ended, F.lit(False)), F.coalesce("_report", empty))).drop("_report")


def matched_files(exams: DataFrame, files: DataFrame) -> DataFrame:
    """The file (name) that best fits each exam (exam_name, exam_year, source_pdf), if any reaches LEAST_SCORE (J18): 10 for
    each common word, 8 for the year in the name, 25 for each hint; then the shorter name, then by name.

    Only pairs with a word or a hint in common are made: without either a file has at most the 8 of its year.
    """
    stem = lambda x: F.regexp_replace(F.substring_index(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\\", "/"), "/", -1), r"(?<=.)\.[^.]*$", "")
    words = lambda x: F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]{2,}"), F.lit(0))), F.array(*map(F.lit, FILE_STOP)))
    base, year = stem("source_pdf"), F.coalesce(F.nullif(F.col("exam_year"), F.lit(0)).cast("string"), F.lit(""))
    name = F.lower(F.coalesce("exam_name", F.lit("")))
    hinted = F.array_compact(F.array(*(F.when(F.contains(name, F.lit(p)), F.lit(f"?{p}")) for p in FILE_HINTS)))
    left = exams.select(*EXAM, "source_pdf").distinct().withColumns({"_year": year, "_a": words(F.concat_ws(" ", name, year)), "_b": words(F.concat_ws(" ", base, year)), "_hints": hinted})
    low = F.lower(stem("name"))
    told = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(h)) for h in hints)), F.lit(f"?{p}")) for p, hints in FILE_HINTS.items())))
    right = files.select("name").distinct().withColumns({"_low": low, "_words": words(low), "_told": told})
    keys = left.select(*EXAM, "source_pdf", "_year", "_a", "_b", "_hints", F.explode(F.array_union(F.array_union("_a", "_b"), F.col("_hints"))).alias("_k"))
    pairs = keys.join(right.withColumn("_k", F.explode(F.array_union("_words", F.col("_told")))), "_k").drop("_k").dropDuplicates([*EXAM, "source_pdf", "name"])
    common = F.greatest(F.size(F.array_intersect("_a", "_words")), F.size(F.array_intersect("_b", "_words")))
    score = common * 10 + F.when((F.col("_year") != "") & F.contains(F.col("_low"), F.col("_year")), 8).otherwise(0) + F.size(F.array_intersect("_hints", "_told")) * 25
    best = I.winners(pairs.withColumn("score", score), [*EXAM, "source_pdf"], [F.desc("score"), F.length("name").asc(), F.asc("name")])
    return best.where(F.col("score") >= LEAST_SCORE).select(*EXAM, "source_pdf", "name", "score")


# lists


def commission_exams(exams: DataFrame, commission: str, needle: str = "") -> DataFrame:
    """A commission's exam types (commission, exam_type, full_name, years, locked) whose type, name, commission or years hold
    the needle, with place: open ones first, then by type with its numbers as numbers (F9)."""
    norm = strip(F.lit(needle))
    text = F.lower(F.concat_ws(" ", "exam_type", "full_name", "commission", F.array_join("years", " ")))
    out = exams.where((F.col("commission") == commission) & F.contains(text, F.lower(norm)))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("commission").orderBy("locked", natural("exam_type"), "exam_type")))


def sanitised(rows: DataFrame, include_all: bool = False) -> DataFrame:
    """Public rows without regional script and with canonical labels (F19): broken ones are dropped; a text that cleaning rejects
    stays as it was, unless it has neither two characters nor two options.  id is unique."""
    seen = rows if include_all else rows.where(F.coalesce(F.col("public_visibility") != "hidden_structural", F.lit(True)))
    fields = [c for c in ("question_text", *Q.OPTIONS, "passage") if c in rows.columns]
    clean = Q.cleaned(seen).select("id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_clean"))
    out = seen.join(clean, "id", "left")
    empty = (F.length(strip("question_text")) < 2) & (reduce(lambda a, b: a + b, ((~blank(o)).cast("int") for o in Q.OPTIONS)) < 2)
    out = out.where(F.col("_clean").isNotNull() | ~empty)
    out = out.withColumns({c: F.when(F.col("_clean"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).drop("_clean", *(f"_{c}" for c in fields))
    return T.applied(out)


def chunk_merged(cached: DataFrame, batch: DataFrame, replace: bool = False) -> DataFrame:
    """The client's rows of an exam (exam_key, id, question_number, position) with a batch put in: what is there stays, the rest
    comes after it; with place by number, those without at 9999, ties as they came (N7)."""
    fresh = batch if replace else batch.join(cached.select("exam_key", "id"), ["exam_key", "id"], "left_anti")
    out = fresh.withColumn("_late", F.lit(1))
    out = out if replace else cached.withColumn("_late", F.lit(0)).unionByName(out)
    order = Window.partitionBy("exam_key").orderBy(F.coalesce("question_number", F.lit(9999)), "_late", "position")
    return out.withColumn("place", F.row_number().over(order)).drop("_late")


def admin_meta(rows: DataFrame, is_active: bool | None = True) -> DataFrame:
    """What the editors' list shows of all rows, or of those of one state; nothing is merged."""
    out = rows if is_active is None else rows.where(F.col("is_active") == is_active)
    return supported(out, META)


def admin_page(rows: DataFrame, page: int = 1, page_size: int = 50, offset: int | None = None) -> DataFrame:
    """One page by number, then time, then id (T9); an offset goes before a page."""
    start = (max(1, page) - 1) * page_size if offset is None else offset
    return I.page(rows, [F.col("question_number").asc_nulls_last(), F.col("created_at").asc_nulls_last(), F.col("id").asc()], start, page_size)


def id_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that a later snapshot lacks or has more."""
    lost, more = before.select("id").join(after, "id", "left_anti"), after.select("id").join(before, "id", "left_anti")
    return lost.withColumn("change", F.lit("missing")).unionByName(more.withColumn("change", F.lit("added")))


# explanations


def explanation_source(made: str = "explanation", contradicted: str | Column = "contradicted") -> Column:
    """Why no explanation is shown, null if one is: deleted question, several answers, none made, contradiction."""
    status = F.lower(strip("answer_status"))
    return F.when(status == "deleted", "deleted-question").when(F.size(F.coalesce("correct_answers", F.array().cast("array<string>"))) > 1, "multiple-correct-answers").when(F.coalesce(F.col(made), F.lit("")) == "", "unavailable-error").when(F.coalesce(col(contradicted), F.lit(False)), "hidden-contradiction")


def safe_explanations(rows: DataFrame, explanations: DataFrame, ids: DataFrame, most: int = 50) -> DataFrame:
    """The explanations of at most `most` asked ids that may be shown at once (C30, batch): none that was made for an answer not
    yet verified, contradicts the answer or is flagged.  ids (id, place); a question that isn't there counts as verified."""
    asked = I.winners(ids, ["id"], ["place"]).orderBy("place").limit(most)
    out = explanations.join(F.broadcast(asked.select(F.col("id").alias("question_id"))), "question_id", "left_semi").where(~blank("explanation"))
    out = out.join(rows.select(F.col("id").alias("question_id"), "correct_answer", "needs_review"), "question_id", "left")
    stale = ~Q._yes("needs_review") & F.contains(F.coalesce("source", F.lit("")), F.lit("unverified-answer"))
    wrong = (F.coalesce("correct_answer", F.lit("")) != "") & implies_other("explanation", "correct_answer")
    return out.where(~(stale | wrong | F.contains(F.col("explanation"), F.lit("[FLAG: verify answer]")))).select("question_id", strip("explanation").alias("explanation"))


def listed_repairs(repairs: DataFrame, questions: DataFrame, exam_name: str | None = None, exam_year: int | None = None, status: str | None = "proposed", limit: int = 200) -> DataFrame:
    """The newest `limit` repairs of a status; with an exam or a year those of them whose question is of it, with exam_name,
    exam_year and question_number (J6).  The limit goes before the exam, as editors page through all of them."""
    rows = (repairs if not status else repairs.where(F.col("status") == status)).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
    if not exam_name and exam_year is None:
        return rows
    of = questions.select(F.col("id").alias("question_id"), "exam_name", "exam_year", "question_number")
    out = rows.join(of, "question_id")
    out = out.where(F.col("exam_name") == exam_name) if exam_name else out
    return out.where(F.col("exam_year") == exam_year) if exam_year is not None else out
