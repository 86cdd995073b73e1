"""Queries that answer customers' typed questions from what they stated about their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import typed as Y
from ..sources.tables import load
from .compiled import _cases, _quoted
from .registry import query

#: What is said with an order (letters a and b, number n), by whom, and what that states: predicate, object, kind, key, confidence.
SAID = (
    ("user", "I made soup {a} with orange and lime.", "completed_action", "made soup {a} with orange and lime", "action", "", 0.9),
    ("user", "I love spice {b}.", "prefers", "spice {b}", "preference", "user:preference:spice_{b}", 0.9),
    ("user", "My goal is to cook stew {b}.", "goal", "cook stew {b}", "goal", "", 0.9),
    ("user", "I now have {n} lamps.", "current_quantity", "{n} lamps", "state", "user:current_quantity:{n}_lamps", 0.9),
    ("user", "I don't like spice {b}.", "avoids", "spice {b}", "preference", "user:preference:spice_{b}", 0.9),
    ("user", "I tried uber eats with mango {a}.", "completed_action", "tried uber eats with mango {a}", "action", "", 0.9),
    ("user", "I plan to grow herb {b}.", "plans", "grow herb {b}", "plan", "", 0.9),
    ("assistant", "You could try pie {a}.", None, None, None, None, None),
    ("user", "I no longer live in Town {a}.", "lives_in", "Town {a}", "state", "user:lives_in", 0.95),
    ("user", "I currently own {n} pots.", "current_quantity", "{n} pots", "state", "user:current_quantity:{n}_pots", 0.9),
)
ASKED = (
    "How many different types of citrus fruits have I used?", "Do I have more or less lamps now?", "What are my preferences for spice?", "How have my preferences for spice changed over time?",
    "What should I cook next, soup or stew?", "Where is the key?", "How many kinds of food delivery services did I use?", "What are my preferences for music?",
)
#: Records that a question may scan here: some customers have more, so their questions fall back.
SCAN = 12


def _turns(spark, d):
    said = F.array(*(F.struct(F.lit(s[0]).alias("role"), F.lit(s[1]).alias("text")) for s in SAID))
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("session_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("turn"), F.element_at(said, (F.floor(F.col("o_orderkey") / 7) % len(SAID)).cast("int") + 1).alias("said"))
    text = F.col("said.text")
    for mark, value in (("{a}", F.element_at(F.array(*map(F.lit, "abcde")), (F.col("turn") % 5).cast("int") + 1)), ("{b}", F.element_at(F.array(*map(F.lit, "pqrs")), (F.col("turn") % 4).cast("int") + 1)), ("{n}", (F.col("turn") % 40).cast("string"))):
        text = F.replace(text, F.lit(mark), value)
    return rows.select("owner", "session_id", "date", "turn", "said.role", text.alias("text"))


def _filled(column: str) -> str:
    return f"replace(replace(replace({column}, '{{a}}', ('abcde')[o_orderkey % 5 + 1]), '{{b}}', ('pqrs')[o_orderkey % 4 + 1]), '{{n}}', cast(o_orderkey % 40 as varchar))"


def _list(words) -> str:
    return "[" + ", ".join(map(_quoted, words)) + "]"


_ROWS = [(k, t.rstrip("."), p, o, kind, key, sure) for k, (who, t, p, o, kind, key, sure) in enumerate(SAID) if p]
_EVIDENCE = f"""{_cases(_ROWS, "said", "k", "excerpt", "predicate", "object", "kind", "key", "confidence")},
e0 as (select o_custkey as owner, cast(o_custkey as varchar) || '-' || year(o_orderdate) as session_id, cast(o_orderdate as date) as date, o_orderkey, {_filled("excerpt")} || '.' as excerpt, predicate, {_filled("object")} as object, kind, nullif({_filled("key")}, '') as key, confidence
  from orders join said on k = (o_orderkey // 7) % {len(SAID)}),
e as (select *, session_id || '-t' || o_orderkey || '-s0' as claim_id, case kind when 'action' then 'completed' when 'plan' then 'planned' when 'goal' then 'goal' else 'current' end as mode, predicate = 'lives_in' as negated,
  row_number() over (partition by owner, coalesce(key, o_orderkey::varchar) order by date desc, session_id desc, o_orderkey desc) = 1 as newest, regexp_replace(key, '^[^:]+:preference:', '') as topic, count(*) over (partition by owner) as records from e0)"""
_PLAN = f"""q as (select c_custkey as question_id, {_list(ASKED)}[c_custkey % {len(ASKED)} + 1] as question, c_custkey % {len(ASKED)} as kind_of from customer),
p as (select *, ['distinct_count', 'latest_state_comparison', 'preference_summary', 'preference_summary', 'personalized_advice', 'unsupported', 'distinct_count', 'preference_summary'][kind_of + 1] as intent, kind_of = 3 as history from q),
r as (select p.question_id, p.intent, p.kind_of, p.history, e.* from p join e on e.owner = p.question_id where e.records <= {SCAN} and not negated and case intent when 'preference_summary' then mode = 'current' and (history or newest)
  when 'personalized_advice' then mode in ('completed', 'current', 'goal') and newest when 'distinct_count' then mode = 'completed' else mode in ('completed', 'current') end)"""


@query(f"""with {_EVIDENCE} select owner, claim_id, session_id, cast(date as varchar) as date, excerpt, mode, negated, predicate, object, case when kind = 'preference' then topic end as topic,
  case when kind = 'state' and predicate = 'current_quantity' then cast(o_orderkey % 40 as double) end as value, case when predicate = 'current_quantity' then regexp_replace(object, '^[0-9]+ ', '') end as context, newest as is_current, confidence from e""")
def m13_evidence_records(spark, d):
    """What every customer stated, as records with mode, number and whether they still hold."""
    e = Y.records(_turns(spark, d))
    numeric = F.col("numeric")
    return e.select("owner", "claim_id", "session_id", F.col("date").cast("string").alias("date"), "excerpt", "mode", "negated", "predicate", "object", "topic", numeric["value"].alias("value"), numeric["context"].alias("context"), (F.col("status") == "current").alias("is_current"), "confidence")


_ANSWERS = f"""with {_EVIDENCE}, {_PLAN},
dc as (select question_id, '' || count(distinct v) || ': ' || string_agg(distinct v, ', ' order by v) || '.' as answer, list_sort(list(distinct claim_id)) as required, min(confidence) as confidence
  from (select *, unnest(list_filter(case when kind_of = 0 then {_list(Y.LEXICONS["citrus_fruit"])} else {_list(Y.LEXICONS["food_delivery_service"])} end, lambda x: contains(object, x))) as v from r where intent = 'distinct_count') group by 1),
ng as (select question_id, context, count(*) as n, list(struct_pack(date := date, claim_id := claim_id, value := value, confidence := confidence) order by date, claim_id) as s, max(hit) as hits
  from (select *, regexp_replace(object, '^[0-9]+ ', '') as context, cast(o_orderkey % 40 as bigint) as value, contains(excerpt, 'lamps')::int + contains(excerpt, 'now')::int as hit from r where intent = 'latest_state_comparison' and predicate = 'current_quantity') group by 1, 2 having count(*) >= 2),
lc as (select question_id, case when z.value < a.value then 'Less' when z.value > a.value then 'More' else 'The same amount of' end || ': from ' || a.value || ' to ' || z.value || ' number.' as answer, [a.claim_id, z.claim_id] as required, least(a.confidence, z.confidence) as confidence
  from (select question_id, s[-2] as a, s[-1] as z, row_number() over (partition by question_id order by hits desc, n desc, context) as k from ng) where k = 1),
ps as (select question_id, list(claim_id order by place) as required, min(confidence) as confidence from (select *, row_number() over (partition by question_id order by date desc, confidence desc, claim_id) as place
  from (select *, row_number() over (partition by question_id, topic order by date desc, claim_id desc) as k from r where intent = 'preference_summary' and kind = 'preference' and kind_of <> 7) where k <= case when history then 2 else 1 end) where place <= {Y.MOST_TOPICS} group by 1),
ad as (select *, kind = 'action' as did, kind in ('goal', 'plan', 'preference') as wants, list_filter(['cook', 'next', 'soup', 'stew'], lambda x: contains(excerpt, x)) as hit from r where intent = 'personalized_advice' and regexp_matches(excerpt, 'cook|next|soup|stew')),
se as (select question_id, session_id, row_number() over (partition by question_id order by len(list_distinct(flatten(list(hit)))) desc, count(*) desc, max(date) desc, session_id desc) as k from ad group by 1, 2 having bool_or(did) and bool_or(wants) and len(list_distinct(flatten(list(hit)))) >= 2),
bo as (select question_id from ad group by 1 having bool_or(did) and bool_or(wants)),
sc as (select ad.*, count(*) filter (wants) over (partition by ad.question_id, object) as often from ad join bo using (question_id) left join (select question_id, session_id as sess from se where k = 1) o on o.question_id = ad.question_id where sess is null or session_id = sess),
s1 as (select *, row_number() over (partition by question_id order by did desc, confidence desc, date desc, claim_id desc) = 1 as is_did from sc),
s2 as (select *, wants and not is_did and row_number() over (partition by question_id order by (wants and not is_did) desc, often desc, confidence desc, date desc, claim_id desc) = 1 as is_wants from s1),
s3 as (select *, row_number() over (partition by question_id order by (is_did or is_wants), date, claim_id) as rest from s2),
pa as (select question_id, max(claim_id) filter (is_did) as d, max(claim_id) filter (is_wants) as w, min(confidence) filter (is_did or is_wants) as confidence, list(claim_id order by rest) filter (not is_did and not is_wants and rest <= {Y.MOST_SUPPORT}) as supporting from s3 group by 1),
f as (select question_id, 'resolved' as status, answer, required, null::varchar[] as supporting, null::varchar as reason, confidence from dc union all select question_id, 'resolved', answer, required, null, null, confidence from lc
  union all select question_id, 'needs_generation', null, required, null, null, confidence from ps
  union all select question_id, case when w is null then 'fallback' else 'needs_generation' end, null, case when w is not null then [d, w] end, case when w is not null then supporting end, case when w is null then {_quoted(Y.REASONS["collapsed"])} end, case when w is null then 0 else confidence end from pa),
n as (select owner, count(*) as records from e group by 1)
select p.question_id, p.intent, coalesce(status, 'fallback') as status, answer, array_to_string(coalesce(required, []), ' ') as required, array_to_string(coalesce(supporting, []), ' ') as supporting,
  case when status is not null then reason when p.intent = 'unsupported' then {_quoted(Y.REASONS["unsupported"])} when coalesce(records, 0) > {SCAN} then {_quoted(Y.REASONS["truncated"])}
    else case p.intent {" ".join(f"when '{k}' then {_quoted(v)}" for k, v in Y.REASONS.items())} end end as reason, coalesce(confidence, 0) as confidence
from p left join f using (question_id) left join n on n.owner = p.question_id"""


@query(_ANSWERS)
def m12_typed_answers(spark, d):
    """A typed answer, contract or reason to fall back for each customer's question."""
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("owner"), F.element_at(F.array(*map(F.lit, ASKED)), (F.col("c_custkey") % len(ASKED)).cast("int") + 1).alias("question"))
    got = Y.answered(asked, Y.records(_turns(spark, d)), SCAN)
    return got.withColumns({c: F.array_join(c, " ") for c in ("required", "supporting")})
