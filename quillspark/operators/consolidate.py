"""Claims of several sessions brought together by topic, and packed for a question in stages, trimmed and put in order of time.

``turns``: question_id, session, date, rank, turn, speaker, text.  A claim is
a clause of a turn with what it states: topics, kinds, polarities.  A topic
that several sessions state is a group, with its latest claim and whether its
stances conflict.  A pack tries, in this order, each session's best claim, the
ledger's anchors, the members of the groups, then all claims by score; a claim
that does not fit is passed over.  The neighbours of what is taken would come
last, but each was tried by score when less was used, so none can fit: that
stage adds nothing.  What the frame of the rendered packet then adds is made
up for by taking out the lowest scored claims that no session needs.

A question's claims are ordered by windows and run as a stream past one
counter; only the taken ones, which the budget bounds, are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ledger as L
from ..functions import statements as S
from ..functions import text as T
from ..functions.chunks import claim_units
from . import claims as P
from .packing import pack

#: Groups of a question, what a stated preference or topic adds.
GROUPS, STATED_PREFERENCE, STATED_TOPIC = 8, 2.0, 1.2
INDEX = "Consolidated evidence index (navigation only; cited source claims below are authoritative)"
CLAIM = P.CLAIM


def claim_rows(turns: DataFrame) -> DataFrame:
    """The clauses of turns, none twice for one session and speaker, with keys, kinds and polarities of what they state."""
    said = claim_units(S.squeezed(F.col("text")))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartition(parts, "question_id")  # what follows stays within a question; a turn is few bytes and much work
    each = turns.select(*(c for c in turns.columns if c != "text"), F.posexplode(said).alias("sentence", "text"))
    first = Window.partitionBy("question_id", "session", "speaker", F.lower("text")).orderBy("turn", "sentence")
    each = each.withColumn("same", F.row_number().over(first)).where("same = 1").drop("same")
    each = each.withColumn("stated", S.stated_claims(F.col("text"), F.col("speaker")))
    part = lambda name: F.array_compact(F.array_distinct(F.transform("stated", lambda c: c[name])))
    return each.select(*(c for c in each.columns if c != "stated"), part("supersession_key").alias("topics"), part("kind").alias("kinds"), part("polarity").alias("polarities"))


def ledger(claims: DataFrame, questions: DataFrame, older: bool = False) -> DataFrame:
    """``claims`` scored, with operation, labels and priority; ``older`` reads bare numbers as running totals."""
    c = P.scored(claims, questions).drop("number_role").withColumn("number_role", L.number_role(F.col("text"), older)) if older else P.scored(claims, questions)
    several = (F.col("operation") == "fact_lookup") & (F.col("kind") == "multi-session")
    c = c.withColumn("operation", F.when(several, "multi_session").otherwise(F.col("operation")))
    more = F.when((F.col("operation") == "preference") & F.array_contains("kinds", "preference"), STATED_PREFERENCE).when((F.col("operation") == "multi_session") & (F.size("topics") > 0), STATED_TOPIC).otherwise(0.0)
    return c.withColumn("priority", F.round(F.col("priority") + more, 6)).withColumn("score", F.round(F.col("relevance") + F.col("priority"), 6))


def groups(claims: DataFrame, limit: int = GROUPS) -> DataFrame:
    """(question_id, topic, sessions, members, latest, conflict, place) of topics that several sessions state.

    ``members`` are (date, -rank, session, turn, sentence), in order of time; a question's first ``limit`` groups by sessions, members and topic.
    """
    each = claims.select("question_id", F.explode("topics").alias("topic"), "session", F.struct("date", (-F.col("rank")).alias("near"), "session", "turn", "sentence").alias("m"), "polarities")
    g = each.groupBy("question_id", "topic").agg(F.count_distinct("session").alias("sessions"), F.count("*").alias("n"), F.sort_array(F.collect_list("m")).alias("members"), F.array_distinct(F.flatten(F.collect_list("polarities"))).alias("p")).where("sessions >= 2")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("sessions"), F.desc("n"), F.desc("topic")))
    g = g.withColumn("place", place).where(F.col("place") <= limit)
    return g.select("question_id", "topic", "sessions", "members", F.element_at("members", -1).alias("latest"), (F.array_contains("p", "positive") & F.array_contains("p", "negative")).alias("conflict"), "place")


def _anchored(c: DataFrame) -> DataFrame:
    """With best (of its session), nth (place among the question's anchors; null beyond)."""
    session, question = Window.partitionBy("question_id", "session"), Window.partitionBy("question_id")
    op, some = F.col("operation"), F.col("overlap") > 0
    hint = some & (
        ((op == "aggregate") & (F.col("number_role") != "unknown")) | ((op == "duration") & F.col("event_role").isin("start", "end")) | ((op == "latest_state") & F.col("mode").isin("completed", "current"))
        | ((op == "preference") & F.array_contains("kinds", "preference")) | ((op == "multi_session") & (F.size("topics") > 0))
    )
    order = [F.desc("priority"), F.desc("date"), "rank", "turn", "sentence"]
    c = c.withColumn("best", F.row_number().over(session.orderBy(F.desc("score"), "turn", "sentence")) == 1).withColumn("hint", hint)
    c = c.withColumn("hint", F.col("hint") & (F.row_number().over(session.orderBy(F.desc("hint"), *order)) <= P.SESSION_ANCHORS))
    nth = F.row_number().over(question.orderBy(F.desc("hint"), *order))
    return c.withColumn("nth", F.when(F.col("hint") & (nth <= P.ANCHORS), nth)).drop("hint")


def staged(c: DataFrame, found: DataFrame, budget: int) -> DataFrame:
    """Scored claims with reason, place, cost and taken."""
    member = found.select("question_id", "place", F.posexplode("members").alias("k", "m")).select("question_id", "m.session", "m.turn", "m.sentence", F.struct("place", "k").alias("at")).groupBy(*CLAIM).agg(F.min("at").alias("at"))
    c = _anchored(c).join(member, CLAIM, "left")
    stage = F.when(F.col("best"), 0).when(F.col("nth").isNotNull(), 1).when(F.col("at").isNotNull(), 2).otherwise(3)
    reason = F.element_at(F.array(*map(F.lit, ("session_coverage", "ledger_anchor", "consolidation_anchor", "ranked_claim"))), stage + 1)
    order = Window.partitionBy("question_id").orderBy(
        stage, F.when(stage == 0, F.col("rank")), F.when(stage == 1, F.col("nth")), F.when(stage == 2, F.col("at")), F.desc("score"), "rank", F.desc("date"), "turn", "session", "sentence"
    )
    c = c.withColumn("reason", reason).withColumn("place", F.row_number().over(order).cast("long")).withColumn("cost", T.token_estimate(F.col("text")) + P.FRAME_TOKENS)
    return pack(c.drop("best", "nth", "at", "topics", "kinds", "polarities"), "question_id", "place", "cost", budget, first_always=True)


def _pieces(text: Column) -> Column:
    """Words and marks of a text, as its token estimate counts them."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), 0))


def _estimate(chars: Column, pieces: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4), F.ceil(F.round(pieces * 1.15, 6))).cast("long")


def trimmed(taken: DataFrame, found: DataFrame, budget: int) -> DataFrame:
    """Taken claims with their line and whether they are kept once the frame is counted, and the size of the packet.

    The estimate adds up over lines: index, session headers, claims.  Claims go
    from the lowest score until the rest fits; a session's best claim stays.
    The index counts as it was before any claim went.
    """
    labels = F.array_compact(F.array(F.nullif("mode", F.lit("unknown")), F.nullif("number_role", F.lit("unknown")), F.nullif("event_role", F.lit("none"))))
    note = F.when(F.size(labels) > 0, F.concat(F.lit(" {"), F.array_join(labels, ","), F.lit("}"))).otherwise("")
    line = F.concat(F.lit("- ["), "speaker", F.lit(" turn "), F.col("turn").cast("string"), F.lit(" sentence "), F.col("sentence").cast("string"), F.lit("]"), note, F.lit(" "), "text")
    head = F.concat(F.lit("Session "), "session", F.lit(" — "), F.date_format("date", "yyyy-MM-dd"))
    rows = taken.where("taken").withColumn("line", line).withColumn("head", head)
    index = index_lines(rows, found).groupBy("question_id").agg(F.sum(F.length("said") + 1).alias("ic"), F.sum(_pieces(F.col("said"))).alias("ip"))
    question, headed = Window.partitionBy("question_id"), Window.partitionBy("question_id", "session", "head")
    rows = rows.join(index, "question_id", "left").withColumn("stays", F.col("reason") == "session_coverage")
    last = F.row_number().over(headed.orderBy(F.desc("stays"), F.desc("score"), "place")) == 1  # a header goes with the last of its claims
    rows = rows.withColumn("chars", F.length("line") + 1 + F.when(last, F.length("head") + 1).otherwise(0)).withColumn("parts", _pieces(F.col("line")) + F.when(last, _pieces(F.col("head"))).otherwise(0))
    low = question.orderBy("stays", "score", F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    left = lambda name, extra: F.sum(name).over(question) + F.coalesce(extra, F.lit(0)) - F.coalesce(F.sum(name).over(low), F.lit(0))
    whole = _estimate(left("chars", F.col("ic")) - 1, left("parts", F.col("ip")))
    rows = rows.withColumn("kept", F.col("stays") | (whole <= budget))
    kept = lambda name: F.sum(F.when(F.col("kept"), F.col(name))).over(question)
    rows = rows.withColumn("packed_tokens", _estimate(kept("chars") + F.coalesce("ic", F.lit(0)) - 1, kept("parts") + F.coalesce("ip", F.lit(0))))
    return rows.drop("chars", "parts", "ic", "ip", "stays")


def retained(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The groups of which claims of two sessions are among ``rows``: members, sessions and latest of these."""
    each = found.select("question_id", "topic", "conflict", "place", F.explode("members").alias("m")).select("question_id", "topic", "conflict", F.col("place").alias("nth"), "m", "m.session", "m.turn", "m.sentence")
    g = each.join(rows.select(*CLAIM), CLAIM, "left_semi").groupBy("question_id", "topic", "conflict", "nth").agg(F.sort_array(F.collect_list("m")).alias("members"), F.count_distinct("session").alias("sessions"))
    return g.where("sessions >= 2")


def index_lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, nth, said): the lines of the index of groups, its heading first."""
    g = retained(rows, found)
    stance = F.when(F.col("conflict"), ", conflicting explicit preference stances").otherwise("")
    said = F.concat(F.lit("- "), "topic", F.lit(": "), F.size("members").cast("string"), F.lit(" cited observations across "), F.col("sessions").cast("string"), F.lit(" sessions; latest citation "), F.element_at("members", -1)["session"], stance)
    head = g.select("question_id").distinct().select("question_id", F.lit(0).alias("nth"), F.lit(INDEX).alias("said"))
    return head.unionByName(g.select("question_id", "nth", said.alias("said")))


def packets(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(question_id, packet, claims, sessions, packed_tokens): the kept claims under their sessions, in order of time, below the index."""
    kept = rows.where("kept")
    order = F.struct("date", "session", "turn", "sentence", "head", "line")
    g = kept.groupBy("question_id").agg(F.sort_array(F.collect_list(order)).alias("s"), F.count_distinct("session").alias("sessions"), F.max("packed_tokens").alias("packed_tokens"))  # within the budget
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x["head"]))
    lines = F.zip_with("s", before, lambda x, b: F.when(b.isNull(), F.concat(x["head"], F.lit("\n"), x["line"])).when(b != x["head"], F.concat(F.lit("\n"), x["head"], F.lit("\n"), x["line"])).otherwise(x["line"]))
    index = index_lines(kept, found).groupBy("question_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "said"))), lambda x: x["said"]), "\n").alias("index"))
    text = F.concat(F.when(F.col("index").isNotNull(), F.concat("index", F.lit("\n\n\n"))).otherwise(""), F.array_join(lines, "\n"))
    return g.join(index, "question_id", "left").select("question_id", text.alias("packet"), F.size("s").cast("long").alias("claims"), "sessions", "packed_tokens")
