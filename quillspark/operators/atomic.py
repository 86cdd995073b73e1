"""Compiled facts for questions: scored, packed within a budget that no fact may exceed, and held against what the operation needs.

``questions``: question_id, owner, question; ``facts``: as ``atoms.compiled``
gives them, with owner; ``ranks``: question_id, session_id, rank (from 0) of
the sessions that retrieval found.  A question meets only the facts of its
owner's retrieved sessions; they are ordered by windows and run as a stream
past one counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import planner as P
from ..functions import text as T
from .packing import pack

#: What questions ask for.
ASKS_NUMBER, ASKS_TIME, ASKS_STATE = r"\b(how many|number|total)\b", r"\b(when|date|how long|before|after)\b", r"\b(current|now|latest|changed|change)\b"
ANCHORS = {
    "date": r"\b(when|date|day|week|month|year|before|after|earliest|latest|elapsed|how long)\b",
    "quantity": r"\b(how many|how much|total|sum|average|difference|more|most|less|price|cost|age|number|amount|limit|gain|growth|followers?|money|spend|spent)\b",
    "state": r"\b(current|currently|now|latest|recent|recently|changed|change|update|updated|no longer|increase|increased|decrease|decreased|raised|reduced|before|used to|formerly|previously)\b",
}
NAMES_DATE = r"(?i)\b(?:19|20)\d{2}\b|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b"
NAME = r"\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})*\b"
#: Weights of a score; sessions and gain of broad questions; of a list item; tokens that a fact's frame takes; score of a user's fact that may matter.
OVERLAP, PHRASE, NUMBER, TIMED, KEYED = 2.0, 0.8, 3.0, 2.0, 2.0
BROAD, BROAD_SESSIONS, BROAD_GAIN, BROAD_STEP = ("aggregate_list", "distinct_count"), 10, 12.0, 0.8
LIST_LEAST, LIST_SHARE, LIST_MOST, FRAME, MATTERS = 2.0, 0.2, 2.0, 4, 6.0
NUMERIC = ("numeric_sum", "numeric_average", "numeric_difference")
LOSSLESS = "deterministic_lossless"
#: What facts are held against, beside question_id, owner, session_id and rank.
ASKED = ("operation", "scope", "targets", "asked", "number", "time", "state", *(f"ask_{n}" for n in ANCHORS), "names")


def rendered() -> Column:
    """A fact as a reader gets it: the unit itself, or what was read from it and its source."""
    where = F.concat_ws(" | ", F.date_format("date", "yyyy-MM-dd"), "speaker", F.concat("session_id", F.lit("#turn-"), F.col("turn").cast("string")))
    own = F.col("qualifiers")["atomic_origin"] == LOSSLESS
    said = F.concat_ws("; ", F.concat(F.lit("subject="), "subject"), F.concat(F.lit("predicate="), "predicate"), F.concat(F.lit("object="), "object"), F.concat(F.lit("date="), F.date_format("event_date", "yyyy-MM-dd")))
    return F.when(own, F.concat(F.lit("[ATOMIC SOURCE | "), where, F.lit("]\n"), "object")).otherwise(F.concat(F.lit("[FACT "), "id", F.lit(" | "), where, F.lit("]\n"), said, F.lit("\nSOURCE: "), "excerpt"))


def asked(questions: DataFrame, ranks: DataFrame) -> DataFrame:
    """A row for each session that was retrieved for a question: question_id, owner, session_id, rank and ``ASKED``, what facts are held against."""
    low = F.lower("question")
    q = questions.select(
        "question_id", "owner", P.plan(F.col("question")).alias("p"), F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)), lambda w: ~w.isin(P.STOP)).alias("asked"),
        *(low.rlike(x).alias(n) for n, x in (("number", ASKS_NUMBER), ("time", ASKS_TIME), ("state", ASKS_STATE))), *(low.rlike(x).alias(f"ask_{n}") for n, x in ANCHORS.items()),
        F.transform(F.regexp_extract_all("question", F.lit(NAME), 0), F.lower).alias("names"),
    )
    q = q.select("question_id", "owner", F.col("p.operation").alias("operation"), F.col("p.scope").alias("scope"), F.col("p.targets").alias("targets"), *ASKED[3:])
    return q.join(ranks, "question_id")


def scored(questions: DataFrame, facts: DataFrame, ranks: DataFrame) -> DataFrame:
    """``judged`` facts of retrieved sessions."""
    return judged(asked(questions, ranks).join(facts, ["owner", "session_id"]))


def judged(r: DataFrame, tasks: int | None = None) -> DataFrame:
    """Facts beside what their question asks (``asked``) with base, score, relevant, anchor, needed, cost, and what packs and contracts read.

    ``relevant``: no supposition, and a target term in subject, predicate,
    object or qualifiers.  ``anchor``: a date, number, state or name that the
    question asks for.  ``needed``: what the operation's contract has to see.

    What a fact says is read where the fact stands; only numbers, flags and
    short names move, once, to their question's partition.
    """
    op, user = F.col("operation"), F.col("speaker") == "user"
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    r = r.withColumn("values", F.array_join(F.array_sort(F.map_values("qualifiers")), " ")).withColumn("low", F.lower("object"))
    r = r.withColumn("words", F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), "object", "excerpt", "values")), F.lit("[a-z0-9]+"), 0)))
    r = r.withColumn("terms", P._terms(F.concat_ws(" ", "subject", F.translate("predicate", "_", " "), "object", "values"))).withColumn("text", F.concat_ws(" ", "object", "excerpt")).withColumn("text_terms", P._terms(F.col("text")))
    base = F.size(F.array_intersect("asked", "words")) * OVERLAP + F.size(F.filter("asked", lambda w: (F.length(w) >= 5) & F.contains(F.col("low"), w))) * PHRASE
    base = base + flag(F.col("number") & F.col("quantity").isNotNull(), NUMBER) + flag(F.col("time") & F.col("event_date").isNotNull(), TIMED) + flag(F.col("state") & F.col("supersession_key").isNotNull(), KEYED) + 1.0 / (F.col("rank") + 1)
    relevant = F.coalesce((F.col("mode") != "hypothetical") & F.arrays_overlap("targets", "terms"), F.lit(False))
    named = F.exists("names", lambda n: F.contains(F.lower("text"), n))
    kinds = (F.col("ask_quantity") & F.col("quantity").isNotNull()) | (F.col("ask_date") & (F.col("event_date").isNotNull() | F.col("text").rlike(NAMES_DATE))) | (F.col("ask_state") & (F.col("supersession_key").isNotNull() | (F.col("kind") == "state")))
    anchor = F.coalesce(named | (kinds & F.arrays_overlap("targets", "text_terms")), F.lit(False))
    declared = (op == "distinct_count") & (F.col("mode") == "asserted") & (F.coalesce(F.col("quantity.role"), F.lit("")) == "declared_cardinality") & ((F.col("scope") == "any") | (F.col("speaker") == F.col("scope")))
    of = lambda name: F.coalesce(F.col("qualifiers")[name], F.lit(""))
    r = r.select(
        "question_id", "operation", "ask_state", "session_id", "rank", "date", "turn", "speaker", "id", "kind", "event_date", "supersession_key", "confidence", F.round(base, 6).alias("base"), relevant.alias("relevant"), anchor.alias("anchor"),
        declared.alias("declared"), (of("atomic_origin") == LOSSLESS).alias("lossless"), (of("closed_world_category") == "true").alias("closed"), F.col("quantity").isNotNull().alias("counted"), F.col("quantity.unit").alias("measure"),
        F.col("object").startswith("|").alias("table"), (T.token_estimate(rendered()) + FRAME).alias("cost"),
    )
    r = by_question(r, tasks).withColumn("declared", F.col("declared") & F.col("relevant"))
    broad = op.isin(*BROAD)
    r = r.withColumn("score", F.col("base") + F.when(broad & user & (F.col("rank") < BROAD_SESSIONS), BROAD_GAIN + (BROAD_SESSIONS - F.col("rank")) * BROAD_STEP).otherwise(0.0))
    peak = F.max("score").over(Window.partitionBy("question_id", "session_id", "turn"))
    r = r.withColumn("score", F.round(F.col("score") + F.when((F.col("kind") == "list_item") & (peak >= LIST_LEAST), F.least(F.lit(LIST_MOST), peak * LIST_SHARE)).otherwise(0.0), 6))
    question = Window.partitionBy("question_id")
    r = r.withColumn("normal", user & F.col("relevant") & ~F.col("lossless"))
    some = lambda c: F.max(c.cast("int")).over(question) == 1
    one = F.sum(F.col("declared").cast("int")).over(question) == 1
    listed = F.when(one, F.col("declared")).when(some(F.col("normal")), F.col("normal")).when(some(user & F.col("relevant")), user & F.col("relevant")).otherwise(F.col("relevant"))
    number = F.col("relevant") & F.col("counted")
    numbers = F.when(some(user & number), user & number).otherwise(number)
    states = user & F.col("relevant") & ((F.col("kind") == "state") | F.col("supersession_key").isNotNull() | ((op == "state_comparison") & F.col("counted")))
    needed = F.when(broad, listed).when(op.isin(*NUMERIC), numbers).when(op.isin("state_comparison", "current_state"), states).when(op.isin("event_order", "temporal_difference"), F.col("relevant") & F.col("event_date").isNotNull()).otherwise(F.lit(False))
    return r.withColumn("needed", needed).drop("normal", "lossless")


def by_question(rows: DataFrame, tasks: int | None) -> DataFrame:
    """Rows in their question's partition, where all windows of packing find them."""
    return rows.repartition(tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "question_id")


def packed(c: DataFrame, budget: int, tasks: int | None = None) -> DataFrame:
    """Scored facts with stage, place and taken.

    Stages: 0 a quota of each session, users first; 1 anchors and needed facts;
    2 the first and the last of each state, if the question asks for states;
    3 what stands beside a taken fact in its turn, and the head of a taken
    item's table; 4 the others.  None is taken that does not fit.

    All facts of a question run past the counter twice, first without those of
    the last stage; they move once in between, nothing is stored or joined.
    """
    best = [F.desc("score"), F.desc("confidence"), F.desc("date"), F.col("id")]
    session = Window.partitionBy("question_id", "session_id")
    user = F.col("speaker") == "user"
    only = F.max(user.cast("int")).over(session) == 1
    nth = F.row_number().over(session.orderBy(F.desc(user), *best))
    quota = F.when(F.col("operation").isin(*BROAD), 2).otherwise(1)
    state = Window.partitionBy("question_id", "supersession_key")
    when = [F.coalesce("event_date", "date"), F.col("date"), F.col("session_id"), F.col("turn"), F.col("id")]
    c = c.withColumn("nth", F.when((~only | user) & (nth <= quota), nth))
    c = c.withColumn("end", F.col("ask_state") & F.col("supersession_key").isNotNull() & ((F.row_number().over(state.orderBy(*when)) == 1) | (F.row_number().over(state.orderBy(*(F.desc(w) for w in when))) == 1)))
    c = c.withColumn("stage", F.when(F.col("nth").isNotNull(), 0).when(F.col("anchor") | F.col("needed"), 1).when(F.col("end"), 2).otherwise(4)).drop("end")
    order = lambda stage: Window.partitionBy("question_id").orderBy(stage, F.when(F.col(stage) == 0, F.col("rank")), F.when(F.col(stage) == 0, F.col("nth")), F.when(F.col(stage) == 2, F.col("supersession_key")), *best)
    first = pack(c.withColumn("place", F.row_number().over(order("stage"))).withColumn("tried", F.when(F.col("stage") < 4, F.col("cost"))), "question_id", "place", "tried", budget)
    c = by_question(first.drop("place", "tried").withColumnRenamed("taken", "in_first"), tasks)
    turn = Window.partitionBy("question_id", "session_id", "turn")
    item = F.max((F.col("in_first") & (F.col("kind") == "list_item")).cast("int")).over(turn) == 1
    heads = F.row_number().over(turn.orderBy(~F.col("table"), "id")) <= 2
    beside = F.coalesce(F.lag("in_first").over(turn.orderBy("id")), F.lit(False)) | F.coalesce(F.lead("in_first").over(turn.orderBy("id")), F.lit(False)) | (item & F.col("table") & heads)
    c = c.withColumn("beside", beside).withColumn("stage", F.when((F.col("stage") == 4) & F.col("beside"), 3).otherwise(F.col("stage")))
    placed = c.withColumn("place", F.row_number().over(order("stage")).cast("long")).drop("in_first", "beside", "nth", "table", "ask_state")
    return pack(placed, "question_id", "place", "cost", budget)


def contracts(rows: DataFrame) -> DataFrame:
    """(question_id, operation, safe, missing, reasons) of packed facts: which slots of its operation a question's pack leaves open."""
    op, user = F.col("operation"), F.col("speaker") == "user"
    state = user & F.col("relevant") & ((F.col("kind") == "state") | F.col("supersession_key").isNotNull() | ((op == "state_comparison") & F.col("counted")))
    dated = F.col("relevant") & F.col("event_date").isNotNull()
    at = F.struct(F.coalesce("event_date", "date"), "turn", "id")
    seen = lambda c, k: F.max_by(F.when(c, F.col("taken")), F.when(c, k))
    early = lambda c, k: F.min_by(F.when(c, F.col("taken")), F.when(c, k))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = rows.groupBy("question_id").agg(
        F.first("operation").alias("operation"), count(state).alias("states"), count(state & ~F.col("taken")).alias("states_left"), F.coalesce(early(state, at), F.lit(False)).alias("has_first"), F.coalesce(seen(state, at), F.lit(False)).alias("has_last"),
        F.count_distinct(F.when(state, F.struct("session_id", "turn"))).alias("places"), F.count_distinct(F.when(state, F.col("supersession_key"))).alias("keys"), count(state & F.col("supersession_key").isNull()).alias("keyless"), count(state & (F.col("measure") == "number")).alias("untyped_states"),
        count(F.col("needed")).alias("needed"), count(F.col("needed") & ~F.col("taken")).alias("needed_left"), F.count_distinct(F.when(F.col("needed"), P.canonical(F.col("measure")))).alias("units"), count(F.col("needed") & (F.col("measure") == "number")).alias("untyped"),
        count(dated).alias("dated"), count(dated & ~F.col("taken")).alias("dated_left"), F.count_distinct(F.when(dated, F.col("event_date"))).alias("days"),
        count(F.col("declared")).alias("declared"), count(F.col("needed") & ~F.col("closed")).alias("open_world"),
        F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.when(F.col("taken"), F.col("session_id"))).alias("in_sessions"), count(F.col("anchor") & ~F.col("taken")).alias("anchors_left"), count(user & (F.col("base") >= MATTERS) & ~F.col("taken")).alias("users_left"),
    )
    lacks = lambda *pairs: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in pairs)))
    comparison = lacks(("previous_state", (F.col("states") < 2) | ~F.col("has_first")), ("current_state", (F.col("states") < 2) | ~F.col("has_last")), ("complete_state_chain", F.col("states_left") > 0), ("distinct_state_sources", F.col("places") < 2), ("normalized_state_identity", (F.col("keys") != 1) | (F.col("keyless") > 0)), ("normalized_state_quantity_role", F.col("untyped_states") > 0))
    current = lacks(("current_state", (F.col("states") < 1) | ~F.col("has_last")), ("state_history_checked", (F.col("states") < 1) | (F.col("states_left") > 0)))
    short = (F.col("needed") < 2) | (F.col("needed_left") > 0)
    numeric = lacks(("left_value", short & (op == "numeric_difference")), ("right_value", short & (op == "numeric_difference")), ("complete_numeric_set", short & (op != "numeric_difference")), ("compatible_units", F.col("units") != 1), ("normalized_quantity_role", F.col("untyped") > 0))
    events = lacks(("dated_event_set", (F.col("dated") < 1) | (F.col("dated_left") > 0)), ("complete_ordered_event_set", (op == "event_order") & (F.col("dated") < 2)), ("start_date", (op == "temporal_difference") & (F.col("days") != 2)), ("end_date", (op == "temporal_difference") & (F.col("days") != 2)))
    one = (op == "distinct_count") & (F.col("declared") == 1)
    lists = lacks(("declared_cardinality", one & (F.col("needed_left") > 0)), ("complete_candidate_set", ~one & ((F.col("needed") < 1) | (F.col("needed_left") > 0))), ("closed_world_category_coverage", ~one & ((F.col("needed") < 1) | (F.col("open_world") > 0))), ("deduplication_key", (op == "distinct_count") & (F.col("needed") < 1)))
    missing = F.when(op == "state_comparison", comparison).when(op == "current_state", current).when(op.isin(*NUMERIC), numeric).when(op.isin("temporal_difference", "event_order"), events).when(op.isin(*BROAD), lists).otherwise(F.array(F.lit("unsupported_operation")))
    reasons = lacks(("retrieved sessions received no evidence allocation", F.col("in_sessions") < F.col("sessions")), ("relevant date/quantity/entity/state anchors were dropped", F.col("anchors_left") > 0), ("operation-required candidate facts were dropped", F.col("needed_left") > 0), ("potentially relevant user statements were truncated", op.isin(*BROAD) & (F.col("users_left") > 0)))
    return g.select("question_id", op.alias("operation"), ((F.size(missing) == 0) & (F.size(reasons) == 0)).alias("safe"), missing.alias("missing"), reasons.alias("reasons"))
