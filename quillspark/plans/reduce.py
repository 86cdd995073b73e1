"""Queries that plan, reduce and bound evidence, score vectors in batches, and build the graph of the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ledger as L
from ..functions import text as T
from ..operators import relational, vector
from ..sources.tables import load
from .packs import QUESTIONS, STOP
from .paths import EDGES, _handovers
from .evidence import x40_response_grounding
from .registry import ORACLES, query
from .retrieval import CEN, VEC, _vectors
from .text import SQUEEZE

#: Intents of typed questions (first match wins).
INTENTS = (
    ("preference_summary", r"\b(prefer|preferences|favou?rite)\b"),
    ("personalized_advice", r"\b(recommend|suggest|should i|could you)\b"),
    ("distinct_count", r"\bhow many (?:different |distinct )?[a-z]+"),
    ("latest_state_comparison", r"\b(current|latest|now|changed)\b"),
)


def _intent_sql() -> str:
    return "case " + " ".join(f"when regexp_matches(lower(question), '{p}') then '{k}'" for k, p in INTENTS) + " else 'unsupported' end"


@query(f"""with q as ({QUESTIONS}) select question_id, {_intent_sql()} as intent,
  case when {_intent_sql()} = 'distinct_count' then regexp_replace(regexp_extract(lower(question), 'how many (?:different |distinct )?([a-z]+)', 1), 's$', '') else '' end as entity,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: len(x) >= 3 and x not in ({STOP})))), ' ') as topic from q""")
def f18_typed_intents(spark, d):
    load(spark, d, "customer").createOrReplaceTempView("__ql_customer")
    q = spark.sql(QUESTIONS.replace("from customer", "from __ql_customer"))
    intent = L.first_of(F.lower("question"), INTENTS, "unsupported")
    named = F.regexp_replace(F.regexp_extract(F.lower("question"), r"how many (?:different |distinct )?([a-z]+)", 1), "s$", "")
    return q.select("question_id", intent.alias("intent"), F.when(intent == "distinct_count", named).otherwise("").alias("entity"), F.array_join(F.array_sort(L.terms(F.col("question"))), " ").alias("topic"))


@query("""with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders),
p as (select o_custkey, o_orderpriority as favourite from (select o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as k from orders group by 1, 2) where k = 1)
select o.o_custkey as question_id, count(distinct case when o_orderstatus = 'F' then o_orderkey end) as finished, max(case when r = 1 then o_orderstatus end) as latest, max(case when r = 2 then o_orderstatus end) as previous,
  coalesce(max(case when r = 1 then o_orderstatus end) <> max(case when r = 2 then o_orderstatus end), false) as changed, any_value(favourite) as preference from o join p on p.o_custkey = o.o_custkey group by 1""")
def m12_typed_reduce(spark, d):
    """For each customer: orders finished, the latest state against the one before, and what is preferred."""
    o = load(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = o.withColumn("r", F.row_number().over(w))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("o_orderstatus")))
    state = r.groupBy("o_custkey").agg(F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("finished"), at(1).alias("latest"), at(2).alias("previous"))
    liked = relational.top_per_key(o.groupBy("o_custkey", "o_orderpriority").count(), ["o_custkey"], [F.desc("count"), F.col("o_orderpriority")], 1)
    out = state.join(liked.select("o_custkey", F.col("o_orderpriority").alias("preference")), "o_custkey")
    changed = F.coalesce(F.col("latest") != F.col("previous"), F.lit(False))
    return out.select(F.col("o_custkey").alias("question_id"), "finished", "latest", "previous", changed.alias("changed"), "preference")


#: Shares of a budget for history, memory and working memory, with their bounds; what a frame takes; what is left for citations at least.
TOKENS, HISTORY, HISTORY_LEAST, HISTORY_MOST, MEMORY, WORKING, FRAME, LEAST = 1200, 0.25, 96, 384, 0.18, 0.1, 120, 80
_TOKENS_SQL = f"cast(greatest(1, floor(length({SQUEEZE}) / 4), ceil(round(len(regexp_extract_all({SQUEEZE}, '[A-Za-z0-9]+|[^ A-Za-z0-9]')) * 1.15, 6))) as bigint)"


@query(f"""with t as (select conv_id, turn, role, {_TOKENS_SQL} as n from conversations), c as (select *, sum(n) over (partition by conv_id order by turn desc, role desc) as used from t)
select conv_id, count(*) filter (used <= {int(min(HISTORY_MOST, max(HISTORY_LEAST, HISTORY * TOKENS)))}) as kept_turns, count(*) filter (used > {int(min(HISTORY_MOST, max(HISTORY_LEAST, HISTORY * TOKENS)))}) as trimmed_turns,
  cast(coalesce(sum(n) filter (used <= {int(min(HISTORY_MOST, max(HISTORY_LEAST, HISTORY * TOKENS)))}), 0) as bigint) as history_tokens,
  cast(greatest({LEAST}, {TOKENS} - {FRAME} - {max(120, int(MEMORY * TOKENS))} - {max(80, int(WORKING * TOKENS))} - coalesce(sum(n) filter (used <= {int(min(HISTORY_MOST, max(HISTORY_LEAST, HISTORY * TOKENS)))}), 0)) as bigint) as citation_tokens from c group by conv_id""")
def m17_context_budget(spark, d):
    """How a budget is shared in each conversation: the newest turns that fit its history, then what is left for citations."""
    most = int(min(HISTORY_MOST, max(HISTORY_LEAST, HISTORY * TOKENS)))
    t = load(spark, d, "conversations").select("conv_id", "turn", "role", T.token_estimate(F.col("text")).alias("n"))
    used = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role")))
    g = t.withColumn("fits", used <= most).groupBy("conv_id").agg(F.count_if("fits").alias("kept_turns"), F.count_if(~F.col("fits")).alias("trimmed_turns"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("n"))), F.lit(0)).alias("history_tokens"))
    rest = TOKENS - FRAME - max(120, int(MEMORY * TOKENS)) - max(80, int(WORKING * TOKENS))
    return g.withColumn("citation_tokens", F.greatest(F.lit(LEAST), rest - F.col("history_tokens")).cast("long"))


@query(f"with {VEC} select query_id, count(*) as hits, round(max(score), 4) as best, round(avg(score), 6) as mean from r where rank <= 10 group by query_id")
def j09_batch_scores(spark, d):
    """A batch of queries against all vectors: how good the ten best of each are."""
    v = _vectors(spark, d)
    best = vector.top_k(v.where("id % 20 = 0"), v, k=10)
    return best.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"with {VEC} select query_id, id, score, rank from r where rank <= 25")
def k02_streamed_topk(spark, d):
    """The same exact search over small blocks of vectors, of which each task keeps the best."""
    v = _vectors(spark, d)
    return vector.top_k(v.where("id % 20 = 0"), v, k=25, block=64)


@query(f"""with {CEN} select vec_id, round(list_dot_product(embedding::double[], centroid), 6) as dot,
  round(list_dot_product(embedding::double[], centroid) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(centroid, centroid)), 6) as cosine from embeddings e join cv on cv.label = e.label""")
def x04_dot_cosine(spark, d):
    """Each vector against the centroid of its label."""
    e = load(spark, d, "embeddings")
    both = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v")).join(vector.centroid_vectors(e, "label"), "label")
    dot = lambda a, b: vector.dot(F.col(a), F.col(b))
    return both.select("vec_id", F.round(dot("v", "centroid"), 6).alias("dot"), F.round(dot("v", "centroid") / F.sqrt(dot("v", "v") * dot("centroid", "centroid")), 6).alias("cosine"))


@query(f"""with e as ({EDGES}), b as (select src as node, dst as neighbor, 1 as o, 0 as i from e union all select dst, src, 0, 1 from e)
select node, neighbor, case when sum(o) > 0 and sum(i) > 0 then 'both' when sum(o) > 0 then 'out' else 'in' end as direction from b group by node, neighbor""")
def r02_neighbors(spark, d):
    e = _handovers(spark, d)
    b = e.select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("neighbor"), F.lit(0).alias("o")))
    out, into = F.max("o") == 1, F.min("o") == 0
    return b.groupBy("node", "neighbor").agg(F.when(out & into, "both").when(out, "out").otherwise("in").alias("direction"))


@query("""with e as (select 'customer:' || o_custkey as src, 'order:' || o_orderkey as dst, 'placed' as kind from orders union select 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' from lineitem
  union select 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by' from lineitem union select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in' from customer)
select src, dst, kind, sha256(src || '|' || kind || '|' || dst) as edge_id from e""")
def r01_graph_build(spark, d):
    """Nodes and edges of the business tables as one edge table, an edge once, with a stable id."""
    def edges(table, a, x, b, y, kind):
        return load(spark, d, table).select(F.concat(F.lit(f"{a}:"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(f"{b}:"), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("kind"))

    e = edges("orders", "customer", "o_custkey", "order", "o_orderkey", "placed").unionByName(edges("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains"))
    e = e.unionByName(edges("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "supplied_by")).unionByName(edges("customer", "customer", "c_custkey", "nation", "c_nationkey", "lives_in"))
    return e.distinct().withColumn("edge_id", F.sha2(F.concat_ws("|", "src", "kind", "dst").cast("binary"), 256))


#: Labels asked for in order, and what a place, a word, a kind and use add to a candidate's score; candidates kept.
LABELS, FIRST, STEP, WORD, KIND, USES, CANDIDATES = ("steel ring", "blue anvil", "red widget"), 240, 18, 24, 6, 10, 50


@query(f"""with w as (select word, count(*) as n from (select unnest(string_split(p_name, ' ')) as word from part) where word in ({", ".join(f"'{w}'" for x in LABELS for w in x.split())}) group by word order by n, word limit 2),
u as (select l_partkey, count(*) as uses from lineitem group by 1),
s as (select p_partkey, p_name, coalesce({FIRST} - {STEP} * (list_position({list(LABELS)}, p_name) - 1), 0) + {WORD} * len(list_filter(string_split(p_name, ' '), lambda x: list_contains(rare, x)))
  + case when p_type = 'ECONOMY' then {KIND} else 0 end + least({USES}, coalesce(uses, 0)) as score from part left join u on l_partkey = p_partkey, (select list(word) as rare from w))
select p_partkey, p_name, cast(score as bigint) as score, row_number() over (order by score desc, p_partkey) as place from s qualify place <= {CANDIDATES}""")
def r12_flow_candidates(spark, d):
    """Parts where a flow may begin: by their label's place among those asked for, the two rarest words, kind and use."""
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_type", F.split("p_name", " ").alias("words"))
    asked = sorted({w for x in LABELS for w in x.split()})
    rare = p.select(F.explode("words").alias("word")).where(F.col("word").isin(asked)).groupBy("word").count().orderBy("count", "word").limit(2)
    rare = rare.agg(F.collect_list("word").alias("rare"))  # two words
    uses = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("uses"))
    at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("p_name"))
    s = p.crossJoin(F.broadcast(rare)).join(uses, "p_partkey", "left")
    score = F.when(at > 0, FIRST - STEP * (at - 1)).otherwise(0) + WORD * F.size(F.filter("words", lambda w: F.array_contains("rare", w))) + F.when(F.col("p_type") == "ECONOMY", KIND).otherwise(0) + F.least(F.lit(USES), F.coalesce("uses", F.lit(0)))
    top = s.select("p_partkey", "p_name", score.cast("long").alias("score")).orderBy(F.desc("score"), "p_partkey").limit(CANDIDATES)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "p_partkey")).cast("long"))


#: Ledger rows that are read for a question; with more the result is not used.
LEDGER_ROWS = 12


@query(f"""with o as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r, count(*) over (partition by o_custkey) as n from orders)
select o_custkey as question_id, n as rows, n > {LEDGER_ROWS} as truncated, case when n <= {LEDGER_ROWS} then cast(count(*) filter (o_orderstatus = 'F') as bigint) end as answer,
  case when n > {LEDGER_ROWS} then 'normal_path' when count(*) filter (o_orderstatus = 'F') = 0 then 'no_evidence' else 'typed_evidence' end as route from o where r <= {LEDGER_ROWS} group by o_custkey, n""")
def m13_runtime_evidence(spark, d):
    """How many finished orders a bounded read of the ledger finds, and whether that read is whole and so used."""
    w = Window.partitionBy("o_custkey")
    o = load(spark, d, "orders").select("o_custkey", "o_orderstatus", F.row_number().over(w.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("r"), F.count("*").over(w).alias("rows")).where(f"r <= {LEDGER_ROWS}")
    g = o.groupBy(F.col("o_custkey").alias("question_id"), "rows").agg(F.count_if(F.col("o_orderstatus") == "F").alias("found"))
    cut = F.col("rows") > LEDGER_ROWS
    route = F.when(cut, "normal_path").when(F.col("found") == 0, "no_evidence").otherwise("typed_evidence")
    return g.select("question_id", "rows", cut.alias("truncated"), F.when(~cut, F.col("found")).alias("answer"), route.alias("route"))


OF_SOURCE, ATTACHED = 3, 24


@query(f"""with k as (select doc_id, source, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as nth from documents where lang = 'en')
select doc_id, source, nth, row_number() over (order by nth > 1, n_chars desc, doc_id) as place from k where nth <= {OF_SOURCE} qualify place <= {ATTACHED}""")
def m20_attachments(spark, d):
    """English documents to attach: up to three of a source, the longest of every source before any second one."""
    k = relational.top_per_key(load(spark, d, "documents").where("lang = 'en'").select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], OF_SOURCE, "nth")
    order = [F.col("nth") > 1, F.desc("n_chars"), F.col("doc_id")]
    top = k.orderBy(*order).limit(ATTACHED)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("doc_id", "source", "nth", "place")


@query(f"""with x as ({ORACLES["x40_response_grounding"]}), c as (select conv_id, count(*) as replies, count(*) filter (quality = 'grounded') as grounded, count(*) filter (quality = 'ungrounded') as ungrounded from x group by conv_id)
select conv_id, replies, round(grounded / replies, 4) as share, case when grounded = replies then 'accepted' when ungrounded * 2 > replies then 'rejected' else 'needs_review' end as state from c""")
def m22_response_review(spark, d):
    """What becomes of a conversation's replies by how well they are grounded."""
    c = x40_response_grounding(spark, d).groupBy("conv_id").agg(F.count("*").alias("replies"), F.count_if(F.col("quality") == "grounded").alias("g"), F.count_if(F.col("quality") == "ungrounded").alias("u"))
    state = F.when(F.col("g") == F.col("replies"), "accepted").when(F.col("u") * 2 > F.col("replies"), "rejected").otherwise("needs_review")
    return c.select("conv_id", "replies", F.round(F.col("g") / F.col("replies"), 4).alias("share"), state.alias("state"))
