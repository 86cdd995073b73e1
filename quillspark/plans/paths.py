"""Queries of strong components, flows, ranked paths, bounded edges and groups by shared terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, paths
from ..sources.tables import load
from .registry import query
from .relational import _rank_sql
from .retrieval import SIMILAR, j08_similar_clusters
from .text import KEY

#: Customers whose orders of one day, priority and status follow each other.
HANDOVER = """select o_custkey as src, lead(o_custkey) over (partition by o_orderdate, o_orderpriority, o_orderstatus order by o_orderkey) as dst from orders"""
EDGES = f"select distinct src, dst from ({HANDOVER}) where src <> dst"
CLOSED = f"""e as materialized ({EDGES}), n as materialized (select src as node from e union select dst from e),
reach as (select src as a, dst as b from e union select a, dst from reach join e on b = src),
scc as materialized (select node, least(node, coalesce((select min(x.b) from reach x join reach y on x.b = y.a and x.a = y.b where x.a = node), node)) as component from n)"""


def _handovers(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("__ql_orders")
    return spark.sql(HANDOVER.replace("from orders", "from __ql_orders")).where("src <> dst").distinct()


@query(f"with recursive {CLOSED} select node, component, count(*) over (partition by component) as size, count(*) over (partition by component) > 1 as is_cycle from scc")
def r08_strong_components(spark, d):
    found = paths.strong_components(_handovers(spark, d))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    return found.join(sizes, "component").select("node", "component", "size", (F.col("size") > 1).alias("is_cycle"))


@query(f"""with recursive {CLOSED}, big as (select component, count(*) as size from scc group by component having count(*) > 1)
select component, size, node as member, row_number() over (partition by component order by node) as place from scc join big using (component)""")
def r14_cycle_members(spark, d):
    found = paths.strong_components(_handovers(spark, d))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    place = F.row_number().over(graph.by("component", "node"))
    return found.join(sizes, "component").select("component", "size", F.col("node").alias("member"), place.cast("long").alias("place"))


#: Ranks as whole numbers, so that sums in another order give the same order.
RANK_UNITS = 1_000_000_000
RANKED = f"select node, cast(floor(rank * {RANK_UNITS} + 0.5) as bigint) as rank from ({_rank_sql(EDGES)})"


def _flow_steps(steps: int) -> str:
    """Greedy steps of a flow as one table each."""
    return "".join(
        f""",
p{k + 1} as materialized (select start, case when dst is null then path else list_append(path, dst) end as path from
  (select p.start, p.path, e.dst, row_number() over (partition by p.start order by rank desc nulls last, e.dst desc) as r
   from p{k} p left join (select src, dst, rank from e join ranked on dst = node) e on p.path[-1] = e.src and not list_contains(p.path, e.dst)) where r = 1)"""
        for k in range(steps)
    )


@query(f"""with ranked as materialized ({RANKED}), e as materialized ({EDGES} ),
p0 as (select node as start, [node] as path from ranked order by rank desc, node limit 20){_flow_steps(5)}
select start, array_to_string(path, ',') as path, len(path) as n from p5 where len(path) > 1""")
def r10_flows(spark, d):
    """From the 20 nodes of the highest rank on, always the neighbour of the highest rank, at most six nodes."""
    e = _handovers(spark, d)
    rank = graph.settled(graph.pagerank(e).select("node", F.floor(F.col("rank") * RANK_UNITS + 0.5).alias("rank")))
    starts = rank.orderBy(F.desc("rank"), "node").limit(20).select(F.col("node").alias("start"), F.lit(0.0).alias("score"))
    ranked = e.join(rank.withColumnRenamed("node", "dst"), "dst")
    found = paths.ranked_paths(starts, ranked, 5, 1, [F.desc("rank"), F.desc("dst")])
    return found.where(F.size("path") > 1).select("start", F.array_join("path", ",").alias("path"), F.size("path").cast("long").alias("n"))


def _beam_steps(steps: int, beam: int) -> str:
    return "".join(
        f""",
g{k + 1} as materialized (select p.start, p.path, w.dst, round(p.score + w.gain, 6) as score from p{k} p join w on p.path[-1] = w.src and not list_contains(p.path, w.dst)),
p{k + 1} as materialized (select start, list_append(path, dst) as path, score from
  (select *, row_number() over (partition by start order by score desc, dst, path) as r from g{k + 1}) where r <= {beam}),
x{k} as (select * from p{k} p where not exists (from g{k + 1} g where g.start = p.start and g.path = p.path))"""
        for k in range(steps)
    )


BEAM, BEAM_STEPS = 6, 4
GAIN = "round(1 + ln(1 + n) + case when status = 'F' then 0.5 else 0 end, 6)"
WEIGHTED = f"""select src, dst, {GAIN} as gain from (select src, dst, count(*) as n, max(o_orderstatus) as status from
  (select o_custkey as src, o_orderstatus, lead(o_custkey) over (partition by o_orderdate, o_orderpriority, o_orderstatus order by o_orderkey) as dst from orders)
  where dst is not null and src <> dst group by src, dst)"""


@query(f"""with w as materialized ({WEIGHTED}),
p0 as materialized (select src as start, [src] as path, cast(count(*) as double) as score from w group by src order by count(*) desc, src limit 6){_beam_steps(BEAM_STEPS, BEAM)}
select start, array_to_string(path, ',') as path, round(score, 4) as score from ({" union all ".join(f"select start, path, score from x{k}" for k in range(BEAM_STEPS))} union all select start, path, score from p{BEAM_STEPS})""")
def r11_ranked_paths(spark, d):
    """Six paths at most from each of the six nodes with the most neighbours, by the sum of what their edges add."""
    load(spark, d, "orders").createOrReplaceTempView("__ql_orders")
    w = graph.settled(spark.sql(WEIGHTED.replace("from orders", "from __ql_orders")))
    starts = w.groupBy(F.col("src").alias("start")).agg(F.count("*").alias("score")).orderBy(F.desc("score"), "start").limit(6)
    total = F.round(F.col("score") + F.col("gain"), 6)
    found = paths.ranked_paths(starts, w, BEAM_STEPS, BEAM, [F.desc(total), "dst"], F.col("gain"))
    return found.select("start", F.array_join("path", ",").alias("path"), F.round("score", 4).alias("score"))


PAIRED = """select least(src, dst) as a, greatest(src, dst) as b, cast(count(*) as double) + round(max(o_totalprice) / 1000000, 6) as score from
  (select o_custkey as src, o_totalprice, lead(o_custkey) over (partition by o_orderdate, o_orderpriority order by o_orderkey) as dst from orders) where src <> dst group by 1, 2"""


def _greedy_sql(candidates: str, most: int, limit: int, digits: int = 6) -> str:
    """One pass over the sorted candidates; the state is the list of ends taken so far."""
    return f"""with recursive c as materialized (select a, b, score, row_number() over (order by score desc, a, b) as i from ({candidates})),
s as (select cast(0 as bigint) as i, cast([] as bigint[]) as ends, 0 as n, false as took
  union all select c.i, case when ok then ends || [c.a, c.b] else ends end, n + cast(ok as int), ok
  from (select s.*, len(list_filter(s.ends, lambda x: x = c.a)) < {most} and len(list_filter(s.ends, lambda x: x = c.b)) < {most} and s.n < {limit} as ok, c.a, c.b, c.i as j from s join c on c.i = s.i + 1) t join c on c.i = t.j)
select a, b, round(score, {digits}) as score from c join s using (i) where took"""


@query(_greedy_sql(PAIRED, 3, 240))
def k13_bounded_edges(spark, d):
    """Pairs of customers who follow each other, the closest first, while both have fewer than three; 240 at most."""
    load(spark, d, "orders").createOrReplaceTempView("__ql_orders")
    return paths.bounded_edges(spark.sql(PAIRED.replace("from orders", "from __ql_orders"))).select("a", "b", F.round("score", 6).alias("score"))


LEAST_SIMILARITY = -0.05


@query(_greedy_sql(f"select a, b, similarity as score from ({SIMILAR}) where similarity >= {LEAST_SIMILARITY}", 3, 240, 4))
def c06_semantic_map_edges(spark, d):
    """Similar clusters as edges of a map, at most three at a cluster."""
    pairs = j08_similar_clusters(spark, d).where(F.col("similarity") >= LEAST_SIMILARITY)
    return paths.bounded_edges(pairs.withColumnRenamed("similarity", "score"))


MOST_ITEMS = 200
TERMS = f"t as materialized (select distinct doc_id as item, unnest({KEY}) as term from documents)"
PAIRS = f"""{TERMS},
few as (select term from t group by term having count(*) between 2 and {MOST_ITEMS}),
pairs as materialized (select x.item as a, y.item as b, count(*) as shared from t x join t y on x.term = y.term and x.item < y.item where x.term in (from few) group by all)"""
#: The same of all terms that two documents have, however many have them.
ALL_PAIRS = f"""{TERMS},
pairs as materialized (select x.item as a, y.item as b, count(*) as shared from t x join t y on x.term = y.term and x.item < y.item group by all)"""
RELATED = f"""{ALL_PAIRS}, n as (select item, count(*) as n from t group by item),
related as materialized (select a, b from pairs join n x on x.item = a join n y on y.item = b where shared >= 3 or shared >= 2 and shared / least(x.n, y.n) >= 0.4)"""


def _terms(spark, d):
    """(item, term) without repeats; ids that come twice are looked for first, as only they can bring any."""
    docs = load(spark, d, "documents")
    each = docs.select(F.col("doc_id").alias("item"), F.explode(T.keyword_set(F.col("text"))).alias("term"))
    return each if docs.groupBy("doc_id").count().where("count > 1").isEmpty() else each.distinct()


@query(f"with {PAIRS} select a, b, shared from pairs")
def j07_shared_term_pairs(spark, d):
    return paths.shared_term_pairs(_terms(spark, d), MOST_ITEMS, unique=True)


@query(f"""with recursive {RELATED}, ends as (select a, b from related union select b, a from related),
reach as (select a, b from ends union select r.a, e.b from reach r join ends e on r.b = e.a)
select a as doc_id, least(a, min(b)) as grp, count(distinct b) as size from (select a, b from reach union select a, a from ends) group by a""")
def c02_lexical_groups(spark, d):
    """Documents in groups of two or more by the terms they share."""
    found = paths.related_groups(_terms(spark, d), unique=True)
    sizes = found.groupBy("group").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "group").select(F.col("item").alias("doc_id"), F.col("group").alias("grp"), "size")
