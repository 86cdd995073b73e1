"""Queries that compile what is said into claims and facts; what each case says is known from its row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import statements as S
from ..operators import atomic as K
from ..operators import atoms as A
from ..sources.tables import load
from .registry import query

#: What is said about order n, by whom, and the claims in it: predicate, object, kind, modality, key, confidence.
STATEMENTS = (
    ("user", "Well, I am currently reading volume {n}. Fine", [("currently_reading", "volume {n}", "state", "asserted", "user:current_activity:reading", 0.92)]),
    ("user", "I am now devouring part {n}!", [("currently_reading", "part {n}", "state", "asserted", "user:current_activity:reading", 0.92)]),
    ("user", "I am currently working on Desk {n}", [("currently_working_on", "Desk {n}", "state", "asserted", "user:current_activity:working_on", 0.92)]),
    ("user", "I currently use the Box {n}.", [("currently_uses", "the Box {n}", "state", "asserted", "user:currently_uses", 0.92)]),
    ("user", "I now have {n} old lamps.", [("current_quantity", "{n} old lamps", "state", "asserted", "user:current_quantity:{n}_old_lamps", 0.9)]),
    ("user", "i own The {n} lamps right now", [("current_quantity", "The {n} lamps", "state", "asserted", "user:current_quantity:{n}_lamps", 0.9)]),
    ("user", "I keep my Key {n} in the hall.", [("currently_stored_at", "the hall", "state", "asserted", "user:stored_location:my_key_{n}", 0.92)]),
    ("user", "My favorite tea is blend {n}.", [("prefers", "blend {n}", "preference", "asserted", "user:preference:favorite:tea", 0.9)]),
    ("user", "I really love the pier {n} over the hill.", [("prefers", "the pier {n}", "preference", "asserted", "user:preference:pier_{n}", 0.9)]),
    ("user", "I would rather walk {n} miles than run.", [("prefers", "walk {n} miles", "preference", "asserted", "user:preference:walk_{n}_miles", 0.9)]),
    ("user", "I don't like noise {n}, but I enjoy rain.", [("avoids", "noise {n}", "preference", "asserted", "user:preference:noise_{n}", 0.9), ("prefers", "rain", "preference", "asserted", "user:preference:rain", 0.9)]),
    ("user", "I usually reach for pen {n}.", [("prefers", "pen {n}", "preference", "asserted", "user:preference:pen_{n}", 0.84)]),
    ("user", "Pen {n} is my usual first choice.", [("prefers", "Pen {n}", "preference", "asserted", "user:preference:pen_{n}", 0.84)]),
    ("user", "What could be {n} is my first choice.", []),
    ("user", "I no longer reach for mug {n} anymore.", [("avoids", "mug {n}", "preference", "asserted", "user:preference:mug_{n}", 0.84)]),
    ("user", "I moved to Town {n} 3 weeks ago. I am based in Port {n}.", [("lives_in", "Town {n}", "state", "asserted", "user:lives_in", 0.9), ("lives_in", "Port {n}", "state", "asserted", "user:lives_in", 0.9)]),
    ("user", "I work at Mill {n} and I work as a Clerk.", [("works_at", "Mill {n}", "state", "asserted", "user:works_at", 0.9), ("role", "Clerk", "state", "asserted", "user:role", 0.9)]),
    ("user", "My name is Kim {n}; my time zone is UTC+{n}; my job title is Cook {n}.", [("name", "Kim {n};", "fact", "asserted", "user:name", 0.9), ("timezone", "UTC+{n};", "state", "asserted", "user:timezone", 0.9), ("role", "Cook {n}", "state", "asserted", "user:role", 0.9)]),
    ("user", "I speak Code {n}. My goal is to swim {n} laps.", [("speaks", "Code {n}", "fact", "asserted", "", 0.9), ("goal", "swim {n} laps", "goal", "asserted", "", 0.9)]),
    ("user", "I have decided to sell {n}. Remember that tide {n} is late.", [("decided", "sell {n}", "action", "asserted", "", 0.9), ("stated_fact", "tide {n} is late", "fact", "asserted", "", 0.9)]),
    ("user", "I plan to paint wall {n} on 2024-05-06.", [("plans", "paint wall {n}", "plan", "asserted", "", 0.9)]),
    ("user", "I finally visited dune {n} yesterday.", [("completed_action", "visited dune {n}", "action", "asserted", "", 0.9)]),
    ("user", "I no longer live in Town {n}. I don't work at Mill {n}", [("lives_in", "Town {n}", "state", "negated", "user:lives_in", 0.95), ("works_at", "Mill {n}", "state", "negated", "user:works_at", 0.95)]),
    ("assistant", "Perhaps try gate {n}. Or consider the rest.", [("suggested_option", "gate {n}", "suggestion", "asserted", "", 0.9)]),
    ("assistant", "I am currently reading volume {n}.", []),
    ("system", "I currently use {n}.", []),
    ("user", "I like tea {n}. I LIKE tea {n}. I like  tea {n}.", [("prefers", "tea {n}", "preference", "asserted", "user:preference:tea_{n}", 0.9)]),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return "values " + ",\n  ".join("(" + ", ".join("null" if x is None else _quoted(x) if isinstance(x, str) else f"{x}::double" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)


def _cases(rows, name: str, *parts) -> str:
    return f"{name}({', '.join(parts)}) as ({_values(rows)})"


_CLAIMS = [(k, i, *c) for k, (_, _, claims) in enumerate(STATEMENTS) for i, c in enumerate(claims)]


@query(
    f"""with {_cases(_CLAIMS, "c", "k", "i", "predicate", "object", "kind", "modality", "supersession_key", "confidence")}
select o_orderkey, cast(i as bigint) as i, predicate, replace(object, '{{n}}', cast(o_custkey as varchar)) as object, kind, modality, replace(supersession_key, '{{n}}', cast(o_custkey as varchar)) as supersession_key, confidence
from orders join c on k = o_orderkey % {len(STATEMENTS)}"""
)
def x18_claim_families(spark, d):
    """Claims of every family of patterns in what is said about each order."""
    said = F.array(*(F.struct(F.lit(who).alias("speaker"), F.lit(text).alias("text")) for who, text, _ in STATEMENTS))
    rows = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.element_at(said, (F.col("o_orderkey") % len(STATEMENTS)).cast("int") + 1).alias("said"))
    text = F.replace(F.col("said.text"), F.lit("{n}"), F.col("o_custkey").cast("string"))
    rows = rows.select("o_orderkey", F.posexplode(S.stated_claims(text, F.col("said.speaker"))).alias("i", "c"))
    return rows.select("o_orderkey", F.col("i").cast("long").alias("i"), "c.predicate", "c.object", "c.kind", "c.modality", F.coalesce("c.supersession_key", F.lit("")).alias("supersession_key"), "c.confidence")


#: A turn of order n on its day, its role, and its facts: predicate, object, kind, mode, value, unit, role, key. An empty object is the whole unit u.
TURNS = (
    ("user", "I now have {n} bikes.\nI just bought a new bike because it rained.", [
        (0, "stated", "", "state", "asserted", "{n}", "bike", "declared_cardinality", "user:current_quantity:bike"),
        (1, "stated", "", "other", "asserted", None, None, None, None),
        (1, "counter_delta", "bike", "event", "asserted", "1", "bike", "counter_increment", None),
        (None, "current_quantity", "{n} bikes", "state", "asserted", "{n}", "number", "mentioned_quantity", "user:current_quantity:{n}_bikes"),
        (None, "completed_action", "bought a new bike because it rained", "event", "asserted", None, None, None, None),
    ]),
    ("user", "We visited {n} castles and paid $1,250.50, twenty five dollars more", [
        (0, "stated", "", "quantity", "asserted", "{n}", "castl", "declared_cardinality", None),
        (0, "stated_quantity_1", "", "quantity", "asserted", "1250.5", "dollars", "mentioned_quantity", None),
        (0, "stated_quantity_2", "", "quantity", "asserted", "25", "dollars", "mentioned_quantity", None),
    ]),
    ("assistant", "| day | km |\n|---|---|\n| {n} | 3% |\n- a plan\n2) never mind", [
        (0, "stated", "", "list_item", "asserted", None, None, None, None),
        (1, "stated", "", "list_item", "asserted", "{n}", "number", "mentioned_quantity", None),
        (1, "stated_quantity_1", "", "list_item", "asserted", "3", "percent", "mentioned_quantity", None),
        (2, "stated", "", "list_item", "asserted", None, None, None, None),
        (3, "stated", "", "list_item", "negated", "2", "number", "mentioned_quantity", None),
    ]),
    ("user", "Dr. Ada Box{n} said so. My doctor, Ada Box, would agree, and Ada Box is my physician.", [
        (0, "stated", "", "other", "hypothetical", None, None, None, None),
        (0, "category_member", "Dr. Ada", "relationship", "asserted", None, None, None, None),
        (0, "category_member", "Ada Box", "relationship", "asserted", None, None, None, None),
    ]),
    ("tool", "I want to pay {n} euros; my dad is one hundred and five", [
        (0, "stated", "", "plan", "asserted", "{n}", "euros", "mentioned_quantity", None),
        (0, "stated_quantity_1", "", "plan", "asserted", "105", "years", "mentioned_quantity", None),
    ]),
    ("system", "I now have {n} bikes.", []),
    ("user", "I attended 2 fairs on March 3rd, 2021.\n\n  i ATTENDED 2 fairs  on march 3rd, 2021.", [
        (0, "stated", "", "quantity", "asserted", "2", "fair", "declared_cardinality", None),
        (None, "completed_action", "attended 2 fairs on March 3rd, 2021", "event", "asserted", "2", "number", "mentioned_quantity", None),
    ]),
)


def _order_turns(spark, d):
    """A customer's orders as the turns of a session of its own a year."""
    said = F.array(*(F.struct(F.lit(role).alias("role"), F.lit(text).alias("text")) for role, text, _ in TURNS))
    rows = load(spark, d, "orders").select(
        F.concat_ws("-", "o_custkey", F.year("o_orderdate")).alias("session_id"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").alias("turn"), F.element_at(said, (F.floor(F.col("o_orderkey") / 3) % len(TURNS)).cast("int") + 1).alias("said")
    )
    return rows.select("session_id", "owner", "date", "turn", "said.role", F.replace(F.col("said.text"), F.lit("{n}"), (F.col("turn") % 50 + 3).cast("string")).alias("text"))


_FACTS = [(k, *f) for k, (_, _, facts) in enumerate(TURNS) for f in facts]
_N = "cast(o_orderkey % 50 + 3 as varchar)"
_FACT_SQL = f"""with {_cases(_FACTS, "f", "k", "unit", "predicate", "object", "kind", "mode", "value", "measure", "role", "supersession_key")}
select o_orderkey as turn, cast(o_custkey as varchar) || '-' || year(o_orderdate) as session_id, cast(unit as int) as unit, predicate, case when object = '' then null else replace(object, '{{n}}', {_N}) end as object, kind, mode,
  cast(replace(value, '{{n}}', {_N}) as double) as value, measure, role, replace(supersession_key, '{{n}}', {_N}) as supersession_key
from orders join f on k = (o_orderkey // 3) % {len(TURNS)}"""


@query(_FACT_SQL)
def m06_compiled_facts(spark, d):
    """Every typed fact of what is said about each order."""
    facts, _ = A.compiled(_order_turns(spark, d))
    whole = F.col("object") == F.col("excerpt")
    own = F.when(~(whole & F.col("predicate").startswith("stated")), F.col("object"))
    return facts.select("turn", "session_id", "unit", "predicate", own.alias("object"), "kind", "mode", "quantity.value", F.col("quantity.unit").alias("measure"), "quantity.role", "supersession_key")


@query(f"""with t as (select o_orderkey, o_custkey, cast(o_orderdate as date) as date, (o_orderkey // 3) % {len(TURNS)} as k from orders),
c as (select o_custkey, date, year(date) as y, o_orderkey, k, cast(o_orderkey % 50 + 3 as double) as n from t where k = 0),
last as (select o_custkey, arg_max(n, (date, cast(o_custkey as varchar) || '-' || y, o_orderkey)) as held, max((date, cast(o_custkey as varchar) || '-' || y, o_orderkey)) as at from c group by 1)
select o_custkey as owner, 'bike' as category, held, 1::double as added, held + 1 as current from last""")
def m06_counters(spark, d):
    """How many bikes each customer has: the last count, and those bought after it (one, in the next unit of the same turn)."""
    turns = _order_turns(spark, d)
    facts, _ = A.compiled(turns)
    owned = facts.withColumn("owner", F.regexp_extract("session_id", "^[^-]*", 0).cast("long"))
    return A.counters(owned, "owner")


UNIT_SQL = r"""u as (select conv_id, turn, role, coalesce(text, '') as text from conversations where role in ('user', 'assistant', 'tool')),
l as (select conv_id, turn, role, unnest(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\v\f]'), lambda x: trim(x, ' ' || chr(9)))) as line, generate_subscripts(regexp_split_to_array(text, '\r\n|[\n\r\v\f]'), 1) as i from u),
s as (select conv_id, turn, i, unnest(p) as part, generate_subscripts(p, 1) as j from (select *, case when regexp_matches(line, '^([-*+] |\|)') or regexp_matches(line, '^\d+[.)]\s+') or length(line) <= 240 then [line]
  else list_filter(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda x: trim(x) <> '') end as p from l where line <> '')),
c as (select conv_id, turn, i, j, q, part[q * 1200 + 1:q * 1200 + 1200] as said from (select *, unnest(range(0, (length(part) - 1) // 1200 + 1)) as q from s)),
n as (select *, lower(regexp_replace(trim(said), '\s+', ' ', 'g')) as plain from c),
k as (select *, row_number() over (partition by conv_id, turn, plain order by i, j, q) as copy from n where plain <> '' and not regexp_matches(said, '^[#*_\-| :]+$')),
units as (select conv_id, turn, row_number() over (partition by conv_id, turn order by i, j, q) - 1 as unit, said from k where copy = 1)"""


@query(f"""with {UNIT_SQL}
select conv_id, turn, cast(unit as int) as unit, sha256(said) as unit_sha256, 'facts_extracted' as status, true as covered, true as verbatim from units""")
def m06_unit_coverage(spark, d):
    """Every unit of every conversation, that facts cover it, and that each fact's excerpt stands in its turn."""
    turns = load(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.lit("2024-03-09").alias("date"), "turn", "role", "text")
    facts, coverage = A.compiled(turns)
    said = turns.select("session_id", "turn", F.lower(S.squeezed(F.col("text"))).alias("whole"))
    stands = facts.join(said, ["session_id", "turn"]).groupBy("session_id", "turn").agg(F.bool_and(F.contains("whole", F.lower(S.squeezed(F.col("excerpt"))))).alias("verbatim"))
    out = coverage.join(stands, ["session_id", "turn"])
    return out.select(F.col("session_id").alias("conv_id"), "turn", "unit", "unit_sha256", "status", (F.size("fact_ids") > 0).alias("covered"), "verbatim")


#: What customers ask of their own turns, and how much of the facts a pack may hold.
QUESTIONS = ("How many bikes do I own now?", "What is the total price of the castles we visited?", "List my fairs in order", "How many fairs did I attend?", "Has the number of my bikes changed?", "Who is my doctor Ada Box?")
BUDGET = 400


#: Turns that a task compiles and packs.
TURNS_OF_A_TASK = 50_000


def _pack(spark, d):
    """Turns move once, to what is asked of their session, and are compiled and scored there."""
    turns = _order_turns(spark, d)
    ask = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("c_custkey") % len(QUESTIONS)).cast("int") + 1)
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_custkey").alias("owner"), ask.alias("question"))
    late = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("session_id"))) - 1
    ranks = turns.select("owner", "session_id").distinct().select(F.col("owner").alias("question_id"), "session_id", late.alias("rank"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // TURNS_OF_A_TASK))
    # merged, as turns that are few enough to be broadcast would be compiled by few tasks
    rows = turns.repartition(tasks, "owner", "session_id").hint("merge").join(K.asked(asked, ranks), ["owner", "session_id"])
    facts, _ = A.compiled(rows, ("question_id", "rank", *K.ASKED), dealt=True)
    return K.packed(K.judged(facts, tasks), BUDGET, tasks)


@query()
def m11_compiled_pack(spark, d):
    """The compiled facts of each customer's question by stage and score, and which fit; tested in tests/test_atomic.py."""
    return _pack(spark, d).select("question_id", "place", "stage", "id", "base", "score", "anchor", "needed", "cost", "taken")


@query()
def m10_atomic_contracts(spark, d):
    """Which slots of its operation each customer's pack leaves open, and why it is not safe; tested in tests/test_atomic.py."""
    got = K.contracts(_pack(spark, d))
    return got.withColumns({c: F.array_join(c, ",") for c in ("missing", "reasons")})
