"""Answers from typed evidence: plans of questions, records of what was stated, and a reducer for each intent.

A question is planned once, to columns that every later step reads: intent,
entity, topics, modes, whether it asks for history.  Evidence of an owner
with more records than a bounded scan may read is not reduced in part: the
question falls back.  So a question meets at most ``SCAN`` records, and all
steps are joins, windows and grouped aggregates over (question, record) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import statements as S
from ..session import settled

#: Records that a scan reads, the least confidence of a record, topics of a summary, supporting records.
SCAN, SURE, MOST_TOPICS, MOST_SUPPORT = 500, 0.75, 8, 6
#: What marks each intent, in this order.
ASKS_PREFERENCE = ("my preferences", "my preference", "my favorite", "my favourite", "what do i prefer", "what do i like", "what do i dislike", "what do i avoid", "do i still like", "do i still prefer")
ASKS_OF_NAMED = (r"\bwhat\s+are\s+[a-z][a-z .'-]{0,40}(?:'s|s')?\s+preferences?\b", r"\bwhat\s+(?:does|did)\s+[a-z][a-z'-]{0,30}\s+(?:(?:usually|generally|typically|normally|tend(?:s)? to)\s+)?prefer\b")
ASKS_ADVICE = ("based on my", "given my", "for me", "my interests", "what should i", "recommend", "suggest", "advice")
ASKS_KINDS = r"\bhow many (?:different |distinct )?(?:types?|kinds?|categories) of ([a-z][a-z -]*?)(?: have| has| did| do| does| were| was| are|\?|$)"
ASKS_CHANGE = ("more or less", "less or more", "switch to more", "switch to less", "switched to more", "switched to less", "increase or decrease", "higher or lower")
ASKS_HISTORY = r"\b(changed|change|history|over time|used to|previously|formerly)\b"
#: Words that name no topic, of questions and of questions for preferences.
NO_TOPIC = (
    "the and for with what which when where how many different types type have used more less should could would about advice struggling you your can some suggest "
    "recommend recommendations current recent recently interesting ideas find new might lately feeling stuck bit that been any getting better results"
).split()
NO_PREFERENCE_TOPIC = (
    "avoid are about changed changes current dislike does did for from favorite favourite generally history how have mine now like likes my normally our over prefer "
    "preference preferences still the time typically usually user what when your"
).split()
#: Names of entities by type.
LEXICONS = {
    "citrus_fruit": ("orange", "lemon", "lime", "grapefruit", "pomelo", "tangerine", "mandarin", "clementine", "yuzu", "kumquat"),
    "food_delivery_service": ("doordash", "door dash", "uber eats", "ubereats", "grubhub", "postmates", "deliveroo", "seamless", "instacart", "foodpanda", "swiggy", "zomato"),
}
#: Mode and tags by kind of statement.
MODES = {"action": "completed", "plan": "planned", "goal": "goal", "suggestion": "suggested"}
TAGS = {"action": ("demonstrated_experience", "event"), "plan": ("stated_goal_or_interest",), "goal": ("stated_goal_or_interest",), "preference": ("preference", "stated_goal_or_interest"), "state": ("state_snapshot",)}
REASONS = {
    "unsupported": "No typed reducer supports this question.",
    "truncated": "The ledger exceeded the bounded scan; a partial result was not used.",
    "distinct_count": "No provenance-valid completed entities were extracted.",
    "latest_state_comparison": "Fewer than two comparable provenance-valid numeric snapshots were extracted.",
    "preference_summary": "No provenance-valid preference facts matched the requested topic.",
    "personalized_advice": "Required personalized-advice anchors are absent.",
    "collapsed": "Personalized-advice anchors collapsed to the same claim.",
}


def _any(text: Column, phrases) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def _words(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0))


def plans(questions: DataFrame) -> DataFrame:
    """``questions`` (question_id, owner, question) with intent, entity, topics, modes and history."""
    low = F.lower(S.squeezed(F.col("question")))
    preference = _any(low, ASKS_PREFERENCE) | low.rlike(ASKS_OF_NAMED[0]) | low.rlike(ASKS_OF_NAMED[1])
    intent = F.when(preference, "preference_summary").when(_any(low, ASKS_ADVICE), "personalized_advice").when(low.rlike(ASKS_KINDS), "distinct_count").when(_any(low, ASKS_CHANGE), "latest_state_comparison").otherwise("unsupported")
    named = F.translate(F.trim(F.regexp_extract(low, ASKS_KINDS, 1)), "- ", "__")
    entity = F.when(named.endswith("ies"), F.regexp_replace(named, "ies$", "y")).otherwise(F.regexp_replace(named, "s$", ""))
    modes = F.when(intent == "preference_summary", F.array(F.lit("current"))).when(intent == "personalized_advice", F.array(*map(F.lit, ("completed", "current", "goal")))).when(intent == "distinct_count", F.array(F.lit("completed"))).otherwise(F.array(F.lit("completed"), F.lit("current")))
    topics = F.when(intent == "preference_summary", F.filter(_words(low, "[a-z0-9]{3,}"), lambda w: ~w.isin(NO_PREFERENCE_TOPIC))).otherwise(F.filter(_words(low, "[a-z]{3,}"), lambda w: ~w.isin(NO_TOPIC)))
    return questions.select("question_id", "owner", "question", intent.alias("intent"), F.when(intent == "distinct_count", entity).alias("entity"), topics.alias("topics"), modes.alias("modes"), low.rlike(ASKS_HISTORY).alias("history"))


def records(turns: DataFrame) -> DataFrame:
    """Evidence of users' turns (owner, session_id, date, turn, role, text): a record a statement; the last of a key is current."""
    stated = turns.where(F.lower("role") == "user").select("owner", "session_id", "date", "turn", F.posexplode(S.stated_claims(F.col("text"), F.col("role"))).alias("i", "c"))
    kinds = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))
    tags = F.create_map(*(x for k, v in TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    number = F.get(Q.quantities_of(F.col("c.object")), F.lit(0))
    context = S.topic_key(F.regexp_replace("c.object", r"[0-9][0-9.,]*", " "))
    key = F.col("c.supersession_key")
    rows = stated.select(
        "owner", "session_id", "date", F.concat_ws("-", "session_id", F.concat(F.lit("t"), F.col("turn").cast("string")), F.concat(F.lit("s"), F.col("i").cast("string"))).alias("claim_id"), F.col("c.excerpt").alias("excerpt"),
        F.coalesce(F.element_at(kinds, F.col("c.kind")), F.lit("current")).alias("mode"), (F.col("c.modality") == "negated").alias("negated"), F.col("c.subject").alias("subject"), F.col("c.predicate").alias("predicate"), F.col("c.object").alias("object"),
        F.lit("text").alias("object_type"), number.alias("q"), context.alias("context"), F.when(F.col("c.kind") == "preference", F.coalesce(F.regexp_replace(key, "^[^:]+:preference:", ""), S.topic_key(F.col("c.object")))).alias("topic"),
        F.coalesce(F.element_at(tags, F.col("c.kind")), F.array().cast("array<string>")).alias("tags"), F.col("c.confidence").alias("confidence"), F.coalesce(key, F.concat_ws("-", "session_id", "turn", "i")).alias("key"), "turn", "i",
    )
    numeric = F.when(F.col("q").isNotNull(), F.struct(F.col("q.value").alias("value"), F.col("q.unit").alias("unit"), F.col("predicate").alias("role"), F.col("context").alias("context")))
    newest = F.row_number().over(Window.partitionBy("owner", "key").orderBy(F.desc("date"), F.desc("session_id"), F.desc("turn"), F.desc("i")))
    status = F.when(newest == 1, "current").otherwise("superseded")
    return rows.withColumn("numeric", numeric).withColumn("status", status).drop("q", "context", "key", "turn", "i")


def _scoped(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """``asked`` with target subjects: those a question for preferences names, else the user; their names are no topics."""
    subjects = evidence.where(F.lower("subject") != "user").select("owner", F.lower("subject").alias("subject")).distinct()
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), 0))
    parts = F.regexp_extract_all(F.translate("subject", "_", " "), F.lit("[a-z0-9]+"), 0)
    named = asked.where("intent = 'preference_summary'").join(subjects, "owner").where((F.size(parts) > 0) & (F.size(F.array_except(parts, tokens)) == 0))
    named = named.groupBy("question_id").agg(F.collect_set("subject").alias("subjects"), F.array_distinct(F.flatten(F.collect_list(parts))).alias("names"))
    out = asked.join(named, "question_id", "left")
    none = F.array().cast("array<string>")
    return out.select(*asked.columns[:5], F.array_except("topics", F.coalesce("names", none)).alias("topics"), "modes", "history", F.when(F.size("subjects") == 1, F.col("subjects")).otherwise(F.array(F.lit("user"))).alias("targets"), "subjects")


def eligible(asked: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question, record) rows that a reducer may use."""
    rows = asked.join(evidence, "owner")
    scope = F.col("subjects").isNull() | F.array_contains("subjects", F.lower("subject"))
    now = (F.col("intent") == "personalized_advice") | ((F.col("intent") == "preference_summary") & ~F.col("history"))
    fits = F.array_contains("targets", F.lower("subject")) & F.array_contains("modes", F.col("mode")) & ~F.col("negated") & (F.col("confidence") >= SURE)
    return rows.where(scope & fits & (~now | (F.col("status") == "current")))


RESULT = ("question_id", "status", "answer", "required", "supporting", "reason", "confidence")


def _result(df: DataFrame, status: str, answer, required, confidence, supporting=None, reason=None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("question_id", F.lit(status).alias("status"), (F.lit(None).cast("string") if answer is None else answer).alias("answer"), required.alias("required"), (none if supporting is None else supporting).alias("supporting"), F.lit(reason).cast("string").alias("reason"), confidence.alias("confidence"))


def distinct_count(rows: DataFrame, lexicons: dict = LEXICONS) -> DataFrame:
    """How many different things of a type completed records name: by their object, or by the type's names in object and excerpt."""
    names = F.create_map(*(x for k, v in lexicons.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    said = F.lower(F.concat_ws(" ", F.translate("object", "_", " "), "excerpt"))
    found = F.filter(F.coalesce(F.element_at(names, F.col("entity")), F.array().cast("array<string>")), lambda n: F.regexp_like(said, F.concat(F.lit("\\b"), n, F.lit("\\b"))))
    own = F.when(F.col("object_type") == F.col("entity"), F.array(F.translate("object", "_", " "))).otherwise(F.array().cast("array<string>"))
    hits = rows.where("intent = 'distinct_count'").select("question_id", "claim_id", "confidence", F.explode(F.concat(own, found)).alias("value"))
    got = hits.groupBy("question_id").agg(F.sort_array(F.collect_set("value")).alias("v"), F.sort_array(F.collect_set("claim_id")).alias("ids"), F.min("confidence").alias("sure"))
    return _result(got, "resolved", F.concat(F.size("v").cast("string"), F.lit(": "), F.array_join("v", ", "), F.lit(".")), F.col("ids"), F.col("sure"))


def _plain(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def latest_comparison(rows: DataFrame) -> DataFrame:
    """The last two numbers of the role, context and unit that the question's topics name most."""
    n = rows.where("intent = 'latest_state_comparison'").where(F.col("numeric").isNotNull())
    said = F.lower(F.concat_ws(" ", "object", "numeric.context", "excerpt"))
    n = n.withColumn("hit", F.filter("topics", lambda t: F.contains(said, t)))
    at = F.struct("date", "claim_id", F.col("numeric.value").alias("value"), "confidence")
    groups = n.groupBy("question_id", "numeric.role", "numeric.context", "numeric.unit").agg(F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("hits"), F.sort_array(F.collect_list(at)).alias("s"))
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("hits"), F.desc("n"), "role", "context", "unit"))
    got = groups.where("n >= 2").withColumn("best", best).where("best = 1").select("question_id", "unit", F.element_at("s", -2).alias("a"), F.element_at("s", -1).alias("z"))
    a, z = F.col("a.value"), F.col("z.value")
    word = F.when(z < a, "Less").when(z > a, "More").otherwise("The same amount of")
    return _result(got, "resolved", F.concat(word, F.lit(": from "), _plain(a), F.lit(" to "), _plain(z), F.lit(" "), F.translate("unit", "_", " "), F.lit(".")), F.array("a.claim_id", "z.claim_id"), F.least("a.confidence", "z.confidence"))


def preference_summary(rows: DataFrame) -> DataFrame:
    """The last record of each topic that the question asks for, the last two if it asks for a history; newest first."""
    p = rows.where("intent = 'preference_summary'").where(F.col("topic").isNotNull() | F.array_contains("tags", "preference"))
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", "object", "predicate", "topic", "excerpt")), F.lit("[a-z0-9]{3,}"), 0)
    p = p.where((F.size("topics") == 0) | F.arrays_overlap("topics", tokens)).withColumn("topic", F.coalesce("topic", "object"))
    k = F.row_number().over(Window.partitionBy("question_id", "topic").orderBy(F.desc("date"), F.desc("claim_id")))
    p = p.withColumn("k", k).where(F.col("k") <= F.when(F.col("history"), 2).otherwise(1))
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("date"), F.desc("confidence"), "claim_id"))).where(F.col("place") <= MOST_TOPICS)
    got = p.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("place", "claim_id"))).alias("s"), F.min("confidence").alias("sure"))
    return _result(got, "needs_generation", None, F.col("s.claim_id"), F.col("sure"))


def personal_advice(rows: DataFrame) -> DataFrame:
    """An experience and an interest of one session that speaks of the topics, else of all sessions, and what supports them."""
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", "object", "predicate", "excerpt")), F.lit("[a-z]{3,}"), 0)
    r = rows.where("intent = 'personalized_advice'").where((F.size("topics") == 0) | F.arrays_overlap("topics", tokens))
    r = r.withColumn("did", F.array_contains("tags", "demonstrated_experience")).withColumn("wants", F.array_contains("tags", "stated_goal_or_interest") | F.array_contains("tags", "preference"))
    r = r.withColumn("hit", F.array_intersect("topics", F.regexp_extract_all(F.lower("excerpt"), F.lit("[a-z]{3,}"), 0)))
    per = r.groupBy("question_id", "session_id").agg(F.bool_or("did").alias("did"), F.bool_or("wants").alias("wants"), F.size(F.array_distinct(F.flatten(F.collect_set("hit")))).alias("cover"), F.count("*").alias("n"), F.max("date").alias("last"), F.first(F.size("topics")).alias("asked"))
    best = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("cover"), F.desc("n"), F.desc("last"), F.desc("session_id")))
    one = per.where(F.col("did") & F.col("wants") & (F.col("cover") >= F.least(F.lit(2), F.col("asked")))).withColumn("best", best).where("best = 1").select("question_id", F.col("session_id").alias("only"))
    both = r.groupBy("question_id").agg(F.bool_or("did").alias("any_did"), F.bool_or("wants").alias("any_wants")).where("any_did and any_wants").select("question_id")
    r = r.join(one, "question_id", "left").join(both, "question_id", "left_semi").where(F.col("only").isNull() | (F.col("session_id") == F.col("only")))
    question = Window.partitionBy("question_id")
    r = r.withColumn("often", F.count(F.when(F.col("wants"), 1)).over(Window.partitionBy("question_id", "object")))
    did = F.row_number().over(question.orderBy(F.desc("did"), F.desc("confidence"), F.desc("date"), F.desc("claim_id")))
    r = r.withColumn("is_did", did == 1)
    free = F.col("wants") & ~F.col("is_did")
    wants = F.row_number().over(question.orderBy(F.desc(free), F.desc("often"), F.desc("confidence"), F.desc("date"), F.desc("claim_id")))
    r = r.withColumn("is_wants", free & (wants == 1))
    rest = F.row_number().over(question.orderBy(F.col("is_did") | F.col("is_wants"), "date", "claim_id"))
    r = r.withColumn("rest", F.when(~F.col("is_did") & ~F.col("is_wants"), rest))
    got = r.groupBy("question_id").agg(
        F.max(F.when(F.col("is_did"), F.col("claim_id"))).alias("d"), F.max(F.when(F.col("is_wants"), F.col("claim_id"))).alias("w"), F.min(F.when(F.col("is_did") | F.col("is_wants"), F.col("confidence"))).alias("sure"),
        F.sort_array(F.collect_list(F.when(F.col("rest") <= MOST_SUPPORT, F.struct("rest", "claim_id")))).alias("s"),
    )
    some = _result(got.where("w is not null"), "needs_generation", None, F.array("d", "w"), F.col("sure"), F.col("s.claim_id"))
    return some.unionByName(_result(got.where("w is null"), "fallback", None, F.array().cast("array<string>"), F.lit(0.0), reason=REASONS["collapsed"]))


def answered(questions: DataFrame, evidence: DataFrame, scan: int = SCAN, lexicons: dict = LEXICONS) -> DataFrame:
    """(question_id, intent, status, answer, required, supporting, reason, confidence) of every question."""
    asked, evidence = plans(questions), settled(evidence)  # every reducer reads it
    counts = evidence.groupBy("owner").agg(F.count("*").alias("records"))
    known = asked.join(counts, "owner", "left")
    small = known.where((F.col("intent") != "unsupported") & (F.coalesce("records", F.lit(0)) <= scan)).drop("records")
    bounded = evidence.join(counts.where(F.col("records") <= scan), "owner").drop("records")
    rows = settled(eligible(_scoped(small, bounded), bounded))
    found = distinct_count(rows, lexicons).unionByName(latest_comparison(rows)).unionByName(preference_summary(rows)).unionByName(personal_advice(rows))
    reason = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    why = F.when(F.col("intent") == "unsupported", F.lit(REASONS["unsupported"])).when(F.coalesce("records", F.lit(0)) > scan, F.lit(REASONS["truncated"])).otherwise(F.element_at(reason, F.col("intent")))
    out = known.join(found, "question_id", "left")
    none, missing = F.array().cast("array<string>"), F.col("status").isNull()
    return out.select(
        "question_id", "intent", F.coalesce("status", F.lit("fallback")).alias("status"), "answer", F.coalesce("required", none).alias("required"), F.coalesce("supporting", none).alias("supporting"),
        F.when(missing, why).otherwise(F.col("reason")).alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )
