"""Scoring claims for a question, their ledger, and packing them first by session, then by anchor, then by score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ledger as L
from .packing import pack

#: Tokens that a claim's frame takes; anchors in all and of a session.
FRAME_TOKENS, ANCHORS, SESSION_ANCHORS = 12, 12, 2
CLAIM = ["question_id", "session", "turn", "sentence"]


def scored(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """``claims`` (question_id, session, date, rank, turn, sentence, speaker, text) with operation, mode, number_role, event_role, overlap, relevance and priority.

    ``questions``: question_id, question, kind.  Relevance adds the inverse
    frequency of shared words among the question's claims, phrases of the
    question, and what numbers, times, speaker and rank give.
    """
    asked = questions.select(
        "question_id", "kind", L.terms(F.col("question")).alias("asked"), L.bigrams(F.col("question")).alias("pairs"), L.plan(F.col("question"), F.col("kind")).alias("operation"),
        F.lower("question").rlike(L.ASKS_NUMBER).alias("number"), F.lower("question").rlike(L.ASKS_BREADTH).alias("breadth"),
        (F.col("kind").contains("temporal") | F.lower("question").rlike(L.ASKS_TIME)).alias("time"),
    )
    every = claims.withColumn("n", F.count("*").over(Window.partitionBy("question_id"))).join(asked, "question_id").withColumn("low", F.lower("text"))
    every = every.withColumn("shared", F.array_intersect("asked", L.terms(F.col("text"))))
    weight = (F.log((F.max("n") + 1) / (F.count("*") + 1)) + 1).alias("weight")
    each = every.select("question_id", "n", F.explode("shared").alias("term")).groupBy("question_id", "term").agg(weight)
    weights = each.groupBy("question_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("weights"))  # as many as the question has words
    lexical = F.aggregate("shared", F.lit(0.0), lambda s, w: s + F.element_at("weights", w))
    user, helper = F.col("speaker") == "user", F.col("kind") == "single-session-assistant"
    phrase = 1.5 * F.size(F.filter("pairs", lambda p: F.contains(F.col("low"), p)))
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    relevance = (
        F.when(F.size("shared") > 0, lexical).otherwise(0.0) + phrase + flag(F.col("number") & F.col("low").rlike(L.SAYS_NUMBER), 1.5) + flag(F.col("time") & F.col("low").rlike(L.SAYS_TIME), 1.0)
        + flag(helper & (F.col("speaker") == "assistant"), 0.75) + flag(~helper & user, 0.25) + 1.0 / (1 + F.col("rank")) + flag(F.col("breadth") & (F.size("shared") > 0), 0.35)
    )
    out = every.join(weights, "question_id", "left").withColumns(
        {"mode": L.assertion_mode(F.col("text"), F.col("speaker")), "number_role": L.number_role(F.col("text")), "event_role": L.event_role(F.col("text")), "overlap": F.size("shared").cast("long"), "relevance": F.round(relevance, 6)}
    )
    number, event, operation = F.col("number_role"), F.col("event_role"), F.col("operation")
    priority = F.least(F.col("overlap"), F.lit(4)) * 0.8 + flag(user & ~helper, 0.6)
    priority += F.when(F.col("mode").isin("completed", "current"), 1.0).when(F.col("mode").isin("planned", "hypothetical", "suggested"), -0.8).otherwise(0.0)
    priority += flag(operation == "aggregate", F.when(number == "cumulative_snapshot", 2.4).when(number == "delta", 1.5).when(number != "unknown", 0.8).otherwise(0.0))
    priority += flag((operation == "duration") & event.isin("start", "end"), 2.2) + flag((operation == "latest_state") & (event == "update"), 1.8)
    return out.withColumn("priority", F.round(priority, 6)).drop("asked", "pairs", "number", "breadth", "time", "low", "shared", "weights", "n")


def packed(claims: DataFrame, budget: int) -> DataFrame:
    """Scored ``claims`` (with tokens) with reason, place and taken, within ``budget`` tokens for each question.

    Tried first is each session's best claim, then the anchors of the question's
    operation, then all by score; the first is taken even if it does not fit.
    """
    score = F.round(F.col("relevance") + F.col("priority"), 6)
    place = ["rank", "turn", "sentence"]
    c = claims.withColumn("score", score)
    session = Window.partitionBy("question_id", "session")
    c = c.withColumn("best", F.row_number().over(session.orderBy(F.desc("score"), "turn", "sentence")) == 1)
    op = F.col("operation")
    anchor = (F.col("overlap") > 0) & (
        ((op == "aggregate") & (F.col("number_role") != "unknown")) | ((op == "duration") & F.col("event_role").isin("start", "end")) | ((op == "latest_state") & F.col("mode").isin("completed", "current"))
    )
    by_priority = [F.desc("anchor"), F.desc("priority"), F.desc("date"), *place]
    c = c.withColumn("anchor", anchor).withColumn("near", F.row_number().over(session.orderBy(*by_priority)))
    c = c.withColumn("anchor", F.col("anchor") & (F.col("near") <= SESSION_ANCHORS))
    question = Window.partitionBy("question_id")
    c = c.withColumn("nth", F.row_number().over(question.orderBy(*by_priority))).withColumn("anchor", F.col("anchor") & (F.col("nth") <= ANCHORS))
    reason = F.when(F.col("best"), "session_coverage").when(F.col("anchor"), "ledger_anchor").otherwise("ranked_claim")
    group = F.when(F.col("best"), 0).when(F.col("anchor"), 1).otherwise(2)
    order = question.orderBy(
        group, F.when(group == 0, F.col("rank")), F.when(group == 1, F.col("nth")), F.desc("score"), "rank", F.desc("date"), "turn", "session", "sentence"
    )
    c = c.withColumn("reason", reason).withColumn("place", F.row_number().over(order).cast("long")).withColumn("cost", F.col("tokens") + FRAME_TOKENS)
    return pack(c.select(*CLAIM, "score", "reason", "place", "cost"), "question_id", "place", "cost", budget, first_always=True)
