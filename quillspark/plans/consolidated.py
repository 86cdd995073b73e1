"""Queries that bring customers' claims together over sessions and pack them in stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as P
from ..operators import consolidate as O
from ..session import settled
from ..sources.tables import load
from . import packs
from .registry import query

#: As ``packs.TURNS`` and ``packs.QUESTIONS``: what is said states preferences that change, and things in use.
TURNS = """select o_custkey as question_id, o_custkey || '-' || year(o_orderdate) as session, o_orderdate as date, 2010 - year(o_orderdate) as rank,
  row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) - 1 as turn,
  case when o_orderkey % 5 = 4 then 'assistant' else 'user' end as speaker,
  case o_orderkey % 5 when 0 then 'I love tea ' || lower(o_orderstatus) || '. It has ' || (o_orderkey % 20) || ' leaves.' when 1 then 'I dislike tea ' || lower(o_orderstatus) || '. Nothing else is new!'
    when 2 then 'I currently use the ' || o_orderstatus || ' desk. I paid ' || cast(floor(o_totalprice) as bigint) || ' in total.' when 3 then 'I finished order ' || o_orderkey || ' yesterday.'
    else 'You could add ' || (o_orderkey % 20) || ' more items to the order.' end as text from orders"""
QUESTIONS = """select c_custkey as question_id,
  case c_custkey % 5 when 0 then 'How many orders did I finish, and how much was paid in total?' when 1 then 'Which tea and desk were there?' when 2 then 'What desk do I currently use now?'
    when 3 then 'Which tea suits this customer?' else 'Which items could you add to the order?' end as question,
  case c_custkey % 5 when 0 then 'multi-session' when 1 then 'multi-session' when 2 then 'knowledge-update' when 3 then 'single-session-preference' else 'single-session-assistant' end as kind from customer"""
BUDGET = 150

_TOPIC = "case when regexp_matches(text, '^I (love|dislike) tea .[.]$') then 'user:preference:tea_' || text[-2] when starts_with(text, 'I currently use') then 'user:currently_uses' end"
_PREFERS = "regexp_matches(text, '^I (love|dislike) tea .[.]$')"
_STATED = f"""{packs.SCORED.replace(packs.TURNS, TURNS).replace(packs.QUESTIONS, QUESTIONS)},
x1 as (select * replace (case when operation = 'fact_lookup' and kind = 'multi-session' then 'multi_session' else operation end as operation), {_TOPIC} as topic, {_PREFERS} as prefers, case when starts_with(text, 'I love tea') then 1 when starts_with(text, 'I dislike tea') then -1 end as pole from m),
x2 as (select * replace (round(priority + case when operation = 'preference' and prefers then {O.STATED_PREFERENCE} when operation = 'multi_session' and topic is not null then {O.STATED_TOPIC} else 0 end, 6) as priority) from x1),
x3 as materialized (select *, round(relevance + priority, 6) as score from x2),
g1 as (select question_id, topic, count(distinct session) as sessions, count(*) as n, count(distinct pole) = 2 as conflict from x3 where topic is not null group by 1, 2 having count(distinct session) >= 2),
g2 as (select *, row_number() over (partition by question_id order by sessions desc, n desc, topic desc) as nth from g1),
g3 as (select x3.question_id, session, turn, sentence, topic, nth, row_number() over (partition by x3.question_id, topic order by date, -rank, session, turn, sentence) as k, count(*) over (partition by x3.question_id, topic) as n, sessions, conflict from x3 join g2 using (question_id, topic) where nth <= {O.GROUPS})"""


def _ledger(spark, d):
    turns = spark.sql(TURNS.replace("from orders", "from {o}"), o=load(spark, d, "orders"))
    questions = spark.sql(QUESTIONS.replace("from customer", "from {c}"), c=load(spark, d, "customer"))
    return O.ledger(O.claim_rows(turns), questions)


@query(f"""with {_STATED} select question_id, topic, cast(sessions as bigint) as sessions, cast(n as bigint) as n, conflict, cast(nth as int) as place, session as latest_session, turn as latest_turn, cast(sentence as int) as latest_sentence from g3 where k = n""")
def m15_consolidation_groups(spark, d):
    """Topics that a customer states in several sessions, with the latest claim and whether stances conflict."""
    g = O.groups(_ledger(spark, d))
    return g.select("question_id", "topic", "sessions", F.size("members").cast("long").alias("n"), "conflict", "place", F.col("latest.session").alias("latest_session"), F.col("latest.turn").alias("latest_turn"), F.col("latest.sentence").alias("latest_sentence"))


@query(f"""with recursive {_STATED},
b as (select x3.*, greatest(1, length(text) // 4, cast(ceil(round(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ A-Za-z0-9]')) * 1.15, 6)) as bigint)) + {P.FRAME_TOKENS} as cost,
  overlap > 0 and (operation = 'aggregate' and number_role <> 'unknown' or operation = 'duration' and event_role in ('start', 'end') or operation = 'latest_state' and mode in ('completed', 'current') or operation = 'preference' and prefers or operation = 'multi_session' and topic is not null) as hint from x3),
f as (select *, row_number() over (partition by question_id, session order by score desc, turn, sentence) = 1 as best, hint and row_number() over (partition by question_id, session order by hint desc, priority desc, date desc, rank, turn, sentence) <= {P.SESSION_ANCHORS} as a from b),
h as (select *, row_number() over (partition by question_id order by a desc, priority desc, date desc, rank, turn, sentence) as nth_a from f),
o as (select h.*, g3.nth as g_nth, g3.k as g_k, case when best then 0 when a and nth_a <= {P.ANCHORS} then 1 when g3.nth is not null then 2 else 3 end as grp from h left join g3 using (question_id, session, turn, sentence)),
p as materialized (select *, row_number() over (partition by question_id order by grp, case when grp = 0 then rank end, case when grp = 1 then nth_a end, case when grp = 2 then g_nth end, case when grp = 2 then g_k end, score desc, rank, date desc, turn, session, sentence) as place from o),
t as (select question_id, place, cost as used, true as taken from p where place = 1
  union all select p.question_id, p.place, case when used + cost <= {BUDGET} then used + cost else used end, used + cost <= {BUDGET} from t join p on p.question_id = t.question_id and p.place = t.place + 1)
select question_id, operation, session, turn, cast(sentence as int) as sentence, score, ['session_coverage', 'ledger_anchor', 'consolidation_anchor', 'ranked_claim'][grp + 1] as reason, place, cost, taken from p join t using (question_id, place)""")
def m14_consolidated_pack(spark, d):
    """Claims for each customer's question by stage: sessions, anchors, members of groups, scores."""
    c = settled(_ledger(spark, d))
    return O.staged(c, O.groups(c), BUDGET).select("question_id", "operation", "session", "turn", "sentence", "score", "reason", "place", "cost", "taken")


@query()
def m14_evidence_packets(spark, d):
    """The packet of each question, and the share of its claims' tokens that packing leaves out."""
    c = settled(_ledger(spark, d))
    found = settled(O.groups(c))
    taken = settled(O.staged(c, found, BUDGET).where("taken"))  # read twice below, packed once
    rows = settled(O.trimmed(taken, found, BUDGET))
    whole = c.groupBy("question_id").agg(F.sum(O.T.token_estimate(F.col("text")) + P.FRAME_TOKENS).alias("all_tokens"))
    got = O.packets(rows, found).join(whole, "question_id")
    return got.select("question_id", "claims", "sessions", "packed_tokens", "all_tokens", F.round(1 - F.col("packed_tokens") / F.col("all_tokens"), 6).alias("left_out"), "packet")
