"""Queries that score claims for questions, label, pack and compare them; claims are said by customers about their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ledger as L
from ..functions import text as T
from ..operators import claims as P
from ..sources.tables import load
from .registry import query

#: A turn an order, a session a year, a question a customer; the same text in Spark and DuckDB.
TURNS = """select o_custkey as question_id, o_custkey || '-' || year(o_orderdate) as session, o_orderdate as date, 2010 - year(o_orderdate) as rank,
  row_number() over (partition by o_custkey, year(o_orderdate) order by o_orderdate, o_orderkey) - 1 as turn,
  case when o_orderkey % 4 = 0 then 'assistant' else 'user' end as speaker,
  case o_orderstatus when 'F' then 'I finished order ' || o_orderkey || ' and paid ' || cast(floor(o_totalprice) as bigint) || ' in total. It started last week!'
    when 'O' then 'I am still waiting for the order now. I will pay ' || cast(floor(o_totalprice) as bigint) || ' next month, maybe later.'
    else 'You could add ' || (o_orderkey % 20) || ' more items to the order. Its status changed, and ' || lower(o_orderpriority) || ' holds.' end as text from orders"""
QUESTIONS = """select c_custkey as question_id,
  case c_custkey % 4 when 0 then 'How many orders did I finish, and how much was paid in total?' when 1 then 'How long did the order take, and when was it finished or started last?'
    when 2 then 'What is the current status of the order I am still waiting for now?' else 'Which items could you add to the order?' end as question,
  case c_custkey % 4 when 0 then 'multi-session' when 1 then 'temporal-reasoning' when 2 then 'knowledge-update' else 'single-session-assistant' end as kind from customer"""
STOP = ", ".join(f"'{w}'" for w in L.LEDGER_STOP_WORDS)
BUDGET = 150


def _rule_sql(column: str, rules, other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}') then '{k}'" for k, p in rules) + f" else '{other}' end"


def _plan_sql() -> str:
    tests = []
    for name, part, pattern in L.PLANS:
        either = ([f"contains(kind, '{part}')"] if part else []) + ([f"regexp_matches(lower(question), '{pattern}')"] if pattern else [])
        tests.append(f"when {' or '.join(either)} then '{name}'")
    return f"case {' '.join(tests)} else 'fact_lookup' end"


def _terms_sql(column: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({column}), '[a-z0-9]+'), lambda x: len(x) >= 3 and x not in ({STOP})))"


SCORED = f"""turns as ({TURNS}), asked as (select *, {_plan_sql()} as operation, {_terms_sql("question")} as asked, list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: x not in ({STOP})) as w from ({QUESTIONS})),
s as (select * exclude (text), unnest(list_filter(string_split(regexp_replace(text, '([.!?])[ ]+', '\\1' || chr(9246), 'g'), chr(9246)), lambda x: x <> '')) as text, generate_subscripts(list_filter(string_split(regexp_replace(text, '([.!?])[ ]+', '\\1' || chr(9246), 'g'), chr(9246)), lambda x: x <> ''), 1) - 1 as sentence from turns),
c as materialized (select * from (select *, row_number() over (partition by question_id, session, speaker, lower(text) order by turn, sentence) as same from s) where same = 1),
k as materialized (select c.*, lower(text) as low, question, kind, operation, asked, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as pairs, list_intersect(asked, {_terms_sql("text")}) as shared,
  count(*) over (partition by question_id) as n from c join asked using (question_id)),
e as (select question_id, session, turn, sentence, n, unnest(shared) as term from k),
x as (select question_id, session, turn, sentence, sum(ln((n + 1) / (df + 1)) + 1) as lexical from (select *, count(*) over (partition by question_id, term) as df from e) group by all),
l as materialized (select k.* exclude (pairs, asked), len(shared) as overlap, case when speaker = 'assistant' then 'suggested' else {_rule_sql("low", L.MODES, "unknown")} end as mode,
  case when not regexp_matches(low, '{L.HAS_NUMBER}') then 'unknown' else {_rule_sql("low", L.NUMBER_ROLES, L.BARE_NUMBER)} end as number_role, {_rule_sql("low", L.EVENTS, "none")} as event_role,
  round(coalesce(lexical, 0) + 1.5 * len(list_filter(list_distinct(pairs), lambda p: contains(low, p)))
    + case when regexp_matches(lower(question), '{L.ASKS_NUMBER}') and regexp_matches(low, '{L.SAYS_NUMBER}') then 1.5 else 0 end
    + case when (contains(kind, 'temporal') or regexp_matches(lower(question), '{L.ASKS_TIME}')) and regexp_matches(low, '{L.SAYS_TIME}') then 1 else 0 end
    + case when kind = 'single-session-assistant' then case when speaker = 'assistant' then 0.75 else 0 end when speaker = 'user' then 0.25 else 0 end
    + 1.0::double / (1 + rank) + case when len(shared) > 0 and regexp_matches(lower(question), '{L.ASKS_BREADTH}') then 0.35 else 0 end, 6) as relevance
  from k left join x using (question_id, session, turn, sentence)),
m as materialized (select *, round(least(overlap, 4) * 0.8::double + case when speaker = 'user' and kind <> 'single-session-assistant' then 0.6 else 0 end
    + case when mode in ('completed', 'current') then 1.0 when mode in ('planned', 'hypothetical', 'suggested') then -0.8 else 0 end
    + case when operation = 'aggregate' then case number_role when 'cumulative_snapshot' then 2.4 when 'delta' then 1.5 when 'unknown' then 0 else 0.8 end else 0 end
    + case when operation = 'duration' and event_role in ('start', 'end') then 2.2 when operation = 'latest_state' and event_role = 'update' then 1.8 else 0 end, 6) as priority from l)"""


def _claims(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("__ql_orders")
    load(spark, d, "customer").createOrReplaceTempView("__ql_customer")
    turns = spark.sql(TURNS.replace("from orders", "from __ql_orders"))
    each = turns.select(*(c for c in turns.columns if c != "text"), F.posexplode(T.sentences(F.col("text"))).alias("sentence", "text"))
    first = P.Window.partitionBy("question_id", "session", "speaker", F.lower("text")).orderBy("turn", "sentence")
    each = each.withColumn("same", F.row_number().over(first)).where("same = 1").drop("same")
    return P.scored(each, spark.sql(QUESTIONS.replace("from customer", "from __ql_customer")))


@query(f"with {SCORED} select question_id, session, turn, sentence, overlap, relevance from m")
def x25_claim_scores(spark, d):
    return _claims(spark, d).select("question_id", "session", "turn", "sentence", "overlap", "relevance")


@query(f"with {SCORED} select question_id, session, turn, sentence, operation, mode, number_role, event_role, round(priority, 4) as priority from m")
def m15_evidence_ledger(spark, d):
    return _claims(spark, d).select("question_id", "session", "turn", "sentence", "operation", "mode", "number_role", "event_role", F.round("priority", 4).alias("priority"))


@query(f"""with recursive {SCORED},
b as (select *, round(relevance + priority, 6) as score, greatest(1, length(text) // 4, cast(ceil(round(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ A-Za-z0-9]')) * 1.15, 6)) as bigint)) + {P.FRAME_TOKENS} as cost,
  overlap > 0 and (operation = 'aggregate' and number_role <> 'unknown' or operation = 'duration' and event_role in ('start', 'end') or operation = 'latest_state' and mode in ('completed', 'current')) as hint from m),
f as (select *, row_number() over (partition by question_id, session order by score desc, turn, sentence) = 1 as best, hint and row_number() over (partition by question_id, session order by hint desc, priority desc, date desc, rank, turn, sentence) <= {P.SESSION_ANCHORS} as a from b),
g as (select *, row_number() over (partition by question_id order by a desc, priority desc, date desc, rank, turn, sentence) as nth from f),
o as (select *, case when best then 0 when a and nth <= {P.ANCHORS} then 1 else 2 end as grp from g),
p as materialized (select *, row_number() over (partition by question_id order by grp, case when grp = 0 then rank end, case when grp = 1 then nth end, score desc, rank, date desc, turn, session, sentence) as place from o),
t as (select question_id, place, cost as used, true as taken from p where place = 1
  union all select p.question_id, p.place, case when used + cost <= {BUDGET} then used + cost else used end, used + cost <= {BUDGET} from t join p on p.question_id = t.question_id and p.place = t.place + 1)
select question_id, session, turn, sentence, score, case grp when 0 then 'session_coverage' when 1 then 'ledger_anchor' else 'ranked_claim' end as reason, place, cost, taken from p join t using (question_id, place)""")
def m14_claim_first_pack(spark, d):
    rows = _claims(spark, d).withColumn("tokens", T.token_estimate(F.col("text")))
    return P.packed(rows, BUDGET)


_NUMBERS = "split_part('" + " ".join(L.SMALL_NUMBERS) + "', ' ', cast({} % 20 + 1 as int))"
_TENS = "split_part('" + " ".join(L.TENS) + "', ' ', cast({} % 8 + 1 as int))"
_SPELLED = f"""case p_partkey % 6 when 0 then {_NUMBERS.format("p_size")} || ' thousand ' || {_NUMBERS.format("(p_partkey // 6)")} || ' hundred and ' || {_TENS.format("p_size")} when 1 then 'dozen'
  when 2 then {_NUMBERS.format("p_size")} || ' dozen' when 3 then 'and' when 4 then {_NUMBERS.format("p_size")} || ' apples' else {_TENS.format("p_partkey")} || ' ' || {_NUMBERS.format("(p_size % 9 + 1)")} end"""


@query(f"""select p_partkey, {_SPELLED} as words, cast(case p_partkey % 6 when 0 then greatest(1, p_size % 20) * 1000 + greatest(1, (p_partkey // 6) % 20) * 100 + (p_size % 8 + 2) * 10 when 1 then 12
  when 2 then p_size % 20 + 12 when 5 then (p_partkey % 8 + 2) * 10 + p_size % 9 + 1 end as double) as value from part""")
def x20_number_words(spark, d):
    words = F.expr(_SPELLED.replace("//", "div"))
    return load(spark, d, "part").select("p_partkey", words.alias("words")).withColumn("value", L.number_words(F.col("words")))


_RULED = """'delivery to this customer ' || case o_orderstatus when 'F' then 'must ship' when 'O' then 'must not ship' else case when o_orderkey % 3 = 0 then 'is enabled' when o_orderkey % 3 = 1 then 'is disabled' else 'waits' end end || ' as ' || lower(o_orderpriority)"""


def _opposite_sql() -> str:
    pairs = [f"contains(x.t, '{a}') and contains(y.t, '{b}') or contains(x.t, '{b}') and contains(y.t, '{a}')" for a, b in L.POLARITY]
    return f"({' or '.join(pairs)}) and len(list_intersect(regexp_extract_all(x.t, '[a-z0-9]{{4,}}'), regexp_extract_all(y.t, '[a-z0-9]{{4,}}'))) >= 2"


@query(f"""with r as (select o_custkey, {_RULED} as t, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as i from orders), e as (select * from r where i <= 6)
select o_custkey, count(*) as n, coalesce(bool_or(c), false) as conflict from (select x.o_custkey, x.i, bool_or({_opposite_sql()}) as c from e x left join e y on x.o_custkey = y.o_custkey and x.t <> y.t group by all) group by o_custkey""")
def x30_polarity_conflict(spark, d):
    """Whether two of a customer's six best pieces of evidence contradict each other."""
    rank = F.row_number().over(P.Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    best = load(spark, d, "orders").select("o_custkey", F.expr(_RULED).alias("t"), rank.alias("i")).where("i <= 6")
    e = best.groupBy("o_custkey").agg(F.collect_list("t").alias("e"))  # six at most
    return e.select("o_custkey", F.size("e").cast("long").alias("n"), F.exists("e", lambda x: F.exists("e", lambda y: (x != y) & L.contradicts(x, y))).alias("conflict"))
