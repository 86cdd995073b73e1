"""Queries of snapshots, epochs, merges, index upkeep, placement, gates and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, relational, stores
from ..session import shared_folder
from ..sources.tables import load
from .registry import ORACLES, query
from .retrieval import g30_topk_overlap
from .text import KEY

SNAPSHOTS = """a as (select l_partkey as k, count(*) || ':' || cast(sum(l_quantity) as bigint) as m from lineitem where l_shipdate < timestamp '1995-06-01' group by 1),
b as (select l_partkey as k, count(*) || ':' || cast(sum(l_quantity) as bigint) as m from lineitem where l_shipdate < timestamp '1995-06-01' and (l_partkey % 5 <> 0 or l_linenumber > 1)
  or l_partkey % 9 = 0 and l_shipdate >= timestamp '1998-06-01' group by 1)"""


@query(f"""with {SNAPSHOTS}, j as (select coalesce(a.k, b.k) as k, a.m as was, b.m as now, a.k is not null as o, b.k is not null as n, coalesce(a.k, b.k) % 7 <> 0 as go from a full join b on a.k = b.k)
select k as l_partkey, was as version, case when not go then 'active' when not n then 'removed' when was = now then 'active' else 'superseded' end as state from j where o
union all select k, now, 'active' from j where go and n and (not o or was <> now)""")
def t04_apply_snapshot(spark, d):
    """Parts' counts before and after a change; candidates of every seventh part are out of date."""
    li = load(spark, d, "lineitem")
    early = "l_shipdate < timestamp_ntz '1995-06-01'"
    mark = F.concat(F.count("*").cast("string"), F.lit(":"), F.sum("l_quantity").cast("long").cast("string")).alias("mark")
    a = li.where(early).groupBy("l_partkey").agg(mark)
    b = li.where(f"{early} and (l_partkey % 5 <> 0 or l_linenumber > 1) or l_partkey % 9 = 0 and l_shipdate >= timestamp_ntz '1998-06-01'").groupBy("l_partkey").agg(mark)
    return stores.apply_snapshot(a, b, "l_partkey", "mark", F.col("l_partkey") % 7 != 0)


@query("""select 1 as epoch, 'superseded' as state, count(*) as rows, cast(sum(o_orderkey) as bigint) as checked from orders where o_orderstatus = 'F'
union all select 2, 'published', count(*), cast(sum(o_orderkey) as bigint) from orders union all select 3, 'rolled_back', count(*), cast(sum(o_orderkey) as bigint) from orders where o_orderstatus <> 'P'""")
def t05_epochs(spark, d):
    """Three versions of orders; the third is staged without some of its rows and does not replace the second."""
    o = load(spark, d, "orders")
    mark = spark.range(1).select(F.uuid()).first()[0]
    store = stores.Epochs(spark, f"{shared_folder(spark).rstrip('/')}/epochs-{spark.sparkContext.applicationId}-{mark}")
    for epoch, staged, whole in ((1, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'F'")), (2, o, o), (3, o.where("o_orderstatus <> 'P'"), o)):
        store.stage(epoch, staged)
        store.publish(epoch, whole.count(), F.col("o_orderkey"))
    return store.manifest()


@query("""with p as (select doc_id as id, n_chars, row_number() over (order by doc_id) - 1 as i from documents where source = 'src1')
select id, i // 100 as step, n_chars % 7 = 0 as conflict, case when n_chars % 7 = 0 then 'src3' else 'src2' end as after_merge, case when n_chars % 7 = 0 then 'src3' when n_chars % 5 = 0 then 'src4' else 'src1' end as after_rollback from p""")
def c09_cluster_merge(spark, d):
    """src1 merged into src2 and rolled back; some documents had moved to src3 before, some go on to src4 in between."""
    n = F.col("n_chars")
    new = F.when(n % 7 == 0, "src3").when(n % 5 == 0, "src4")
    rows = load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), new.alias("new_cluster"), (n % 7 == 0).alias("gone"))
    return stores.merged(rows, "src1", "src2", F.col("gone"))


INDEXED = """s as (select doc_id as id, n_chars % 3 as m from documents), i as (select vec_id * 2 as id, label % 3 as m from embeddings),
p as (select coalesce(s.id, i.id) as id, case when i.id is null then 'missing' when s.id is null then 'orphan' when s.m <> i.m then 'stale' end as action from s full join i on s.id = i.id)"""


def _index_plan(spark, d):
    s = load(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 3).cast("long").alias("mark"))
    i = load(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("id"), (F.col("label") % 3).cast("long").alias("mark"))
    return stores.index_plan(s, i, "id", "mark"), i


@query(f"with {INDEXED} select id, action from p where action is not null")
def c12_index_plan(spark, d):
    return _index_plan(spark, d)[0]


@query(f"""with {INDEXED}, n as (select count(*) filter (action in ('missing', 'stale')) as added, count(*) filter (action in ('orphan', 'stale')) as removed from p)
select added, removed, case when added + removed >= ceil(0.15 * (select count(*) from i)) then 'rebuild' else 'delta' end as decision from n""")
def c12_index_decision(spark, d):
    plan, index = _index_plan(spark, d)
    return stores.index_decision(plan, index.count())


#: What an approximate index has to reach.
GATES = {"min_chunk_count": 10_000, "avg_overlap_at_10": 0.95, "min_query_overlap_at_10": 0.85}


@query(f"""with o as ({ORACLES["g30_topk_overlap"]}), n as (select count(*) as n from embeddings), m as (select round(avg(overlap), 6) as a, min(overlap) as b from o)
select 'min_chunk_count' as id, cast(n as double) as value, n >= 10000 as ok from n union all select 'avg_overlap_at_10', a, a >= 0.95 from m union all select 'min_query_overlap_at_10', b, b >= 0.85 from m""")
def c11_acceptance_gate(spark, d):
    """Whether a search over half of each vector would pass in place of the exact one."""
    seen = g30_topk_overlap(spark, d).agg(F.round(F.avg("overlap"), 6).alias("avg_overlap_at_10"), F.min("overlap").alias("min_query_overlap_at_10"))
    n = load(spark, d, "embeddings").agg(F.count("*").cast("double").alias("min_chunk_count"))
    one = n.crossJoin(seen)  # one row each
    rows = F.array(*(F.struct(F.lit(k).alias("id"), F.col(k).alias("value"), (F.col(k) >= v).alias("ok")) for k, v in GATES.items()))
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(f"""with n as (select source, count(*) as n, round(max(c) / sum(c), 4) as cohesion from (select source, lang, count(*) as c from documents group by all) group by source),
c as (select source, count(*) as n from documents group by source),
e as (select source, term, count(*) as df from (select source, unnest(list_distinct({KEY})) as term from documents) group by all),
prof as (select r.source, term, round(df / c.n, 6) as weight from (select *, row_number() over (partition by source order by df desc, term) as rank from e) r join c on r.source = c.source where rank <= 32),
q as (select item_id, term, count(*) over (partition by item_id) as terms from (select distinct item_id, unnest({KEY}) as term from benchmark)),
s as (select item_id, source, round(0.82::double * least(1.0, sum(weight) / greatest(2.0, any_value(terms) * 0.25)) + 0.18::double * case when any_value(cohesion) > 0 then any_value(cohesion) else 0.5 end, 6) as score, any_value(cohesion) as cohesion
  from q join prof using (term) join n using (source) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, source desc) as k, lead(score, 1, 0.0) over (partition by item_id order by score desc, source desc) as second from s)
select item_id, source, score, round(score - second, 6) as margin, score >= 0.72 and score - second >= 0.2 and (cohesion = 0 or cohesion >= 0.55) as placed from r where k = 1""")
def x27_placement_score(spark, d):
    """Benchmark items against the term profiles of sources; cohesion is the share of a source's main language."""
    docs = load(spark, d, "documents")
    cohesion = docs.groupBy("source", "lang").count().groupBy("source").agg(F.round(F.max("count") / F.sum("count"), 4).alias("cohesion"))
    words = F.array_distinct(T.keyword_tokens(F.col("text")))
    q = load(spark, d, "benchmark").select("item_id", words.alias("w")).select("item_id", F.size("w").alias("terms"), F.explode("w").alias("term"))
    hit = q.join(lexical.term_profile(docs, "source"), "term").groupBy("item_id", "source").agg(F.sum("weight").alias("overlap"), F.first("terms").alias("terms")).join(cohesion, "source")
    score = 0.82 * F.least(F.lit(1.0), F.col("overlap") / F.greatest(F.lit(2.0), F.col("terms") * 0.25)) + 0.18 * F.when(F.col("cohesion") > 0, F.col("cohesion")).otherwise(0.5)
    w = relational.ordered(["item_id"], [F.desc("score"), F.desc("source")])
    r = hit.withColumn("score", F.round(score, 6)).withColumn("k", F.row_number().over(w)).withColumn("second", F.lead("score", 1, 0.0).over(w)).where("k = 1")
    margin, sure = F.col("score") - F.col("second"), (F.col("cohesion") == 0) | (F.col("cohesion") >= 0.55)
    return r.select("item_id", "source", "score", F.round(margin, 6).alias("margin"), ((F.col("score") >= 0.72) & (margin >= 0.2) & sure).alias("placed"))


@query("""with o as (select p_brand, cast(p_size as double) as "at", avg(p_retailprice) as value from part where p_partkey % 2 = 0 group by all), g as (select distinct p_brand, p_size + 0.3::double as guess from part where p_partkey % 2 = 1),
l as (select g.p_brand, guess, arg_max(o, o."at") filter (o."at" <= guess) as a, arg_min(o, o."at") filter (o."at" >= guess) as z from g join o on o.p_brand = g.p_brand group by all), k as (select p_brand, guess, coalesce(a, z) as lo, coalesce(z, a) as hi from l)
select p_brand, guess, round(case when lo."at" = hi."at" then lo.value else round(lo.value + (hi.value - lo.value) * least(1.0, greatest(0.0, (guess - lo."at") / greatest(hi."at" - lo."at", 0.1))), 6) end, 5) as p_retailprice from k""")
def x35_interpolated_price(spark, d):
    """Prices of odd parts' sizes on the line between even parts of their brand."""
    p = load(spark, d, "part")
    guesses = p.where("p_partkey % 2 = 1").select("p_brand", (F.col("p_size") + 0.3).cast("double").alias("guess")).distinct()
    got = stores.interpolated(p.where("p_partkey % 2 = 0"), guesses, "p_brand", "p_size", "p_retailprice", 6)
    return got.withColumn("p_retailprice", F.round("p_retailprice", 5))


SEEDS, QUOTA, MOST_SEEDS = ("steel", "blue", "brand#12", "economy", "widget"), 4, 24
_HIT = "8 * cast(list_contains(string_split(lower(p_name), ' '), term) as int) + 5 * cast(lower(p_brand) = term as int) + 3 * cast(lower(p_type) = term as int)"


@query(f"""with h as (select p_partkey, term, {_HIT} as score, (select count(*) from part) as n from part, (select unnest({list(SEEDS)}) as term)),
s as (select * from h where score > 0), t as (select p_partkey, cast(sum(score) as bigint) as total from s group by 1),
q as (select s.p_partkey, min(k) as k from (select s.*, row_number() over (partition by term order by total desc, s.p_partkey) as k from s join t using (p_partkey)) s group by 1),
r as (select t.p_partkey, total, k <= {QUOTA} as balanced, row_number() over (order by k <= {QUOTA} desc, total desc, t.p_partkey) as place from t join q using (p_partkey)) select p_partkey, total, balanced, place from r where place <= {MOST_SEEDS}""")
def k15_seeds(spark, d):
    """The best parts for some words: up to four for each word first, then the best of all, 24 in all."""
    p = load(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("name"), F.lower("p_brand").alias("brand"), F.lower("p_type").alias("type"))
    hit = lambda w: 8 * F.array_contains("name", w).cast("int") + 5 * (F.col("brand") == w).cast("int") + 3 * (F.col("type") == w).cast("int")
    each = p.select("p_partkey", F.explode(F.array(*(F.struct(F.lit(w).alias("term"), hit(w).alias("score")) for w in SEEDS))).alias("h")).select("p_partkey", "h.*").where("score > 0")
    total = each.groupBy("p_partkey").agg(F.sum("score").cast("long").alias("total"))
    best = relational.top_per_key(each.join(total, "p_partkey"), ["term"], [F.desc("total"), F.col("p_partkey")], QUOTA).select("p_partkey").distinct().withColumn("b", F.lit(True))
    marked = total.join(best, "p_partkey", "left").withColumn("balanced", F.coalesce("b", F.lit(False)))
    top = marked.orderBy(F.desc("balanced"), F.desc("total"), "p_partkey").limit(MOST_SEEDS)
    place = F.row_number().over(relational.ordered([], [F.desc("balanced"), F.desc("total"), F.col("p_partkey")]))
    return top.select("p_partkey", "total", "balanced", place.cast("long").alias("place"))


@query("""with s as (select o_orderstatus as k, count(*) as n, cast(floor(sum(o_totalprice)) as bigint) as total from orders group by 1),
l as (select '| ' || k || ' | ' || n || ' | ' || total || ' |' as line, row_number() over (order by n desc, k) + 2 as place, '{"status":"' || k || '","n":' || n || ',"total":' || total || '}' as json from s)
select place, line, json from l union all select 1, '| status | n | total |', null union all select 2, '|---|---|---|', null""")
def s28_report(spark, d):
    """Orders by status as lines of a Markdown table and as JSON, written as text and read back."""
    s = load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.floor(F.sum("o_totalprice")).alias("total"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("status"), F.col("n").cast("string"), F.col("total").cast("string")), F.lit(" |"))
    place = F.row_number().over(relational.ordered([], [F.desc("n"), F.col("status")])) + 2  # a row a status
    body = s.select(place.cast("long").alias("place"), line.alias("line"), F.to_json(F.struct("status", "n", "total")).alias("json"))
    head = spark.range(1, 3).select(F.col("id").alias("place"), F.when(F.col("id") == 1, "| status | n | total |").otherwise("|---|---|---|").alias("line"), F.lit(None).cast("string").alias("json"))
    path = f"{shared_folder(spark).rstrip('/')}/report-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    head.unionByName(body).write.json(path)
    return spark.read.schema("place long, line string, json string").json(path)


@query("""with e as (select o_custkey as src, lead(o_custkey) over (partition by o_orderdate, o_orderpriority, o_orderstatus order by o_orderkey) as dst, o_orderstatus as kind from orders), g as (select src, dst, kind, count(*) as n from e where src <> dst group by all)
select src as node, '- customer ' || src || chr(10) || string_agg('  - ' || kind || ' -> ' || dst || ' (' || n || ')', chr(10) order by dst, kind) as block from g group by src""")
def s30_graph_markdown(spark, d):
    """Who follows whom, a block of Markdown for each customer."""
    w = relational.ordered(["o_orderdate", "o_orderpriority", "o_orderstatus"], [F.col("o_orderkey")])
    e = load(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.lead("o_custkey").over(w).alias("dst"), F.col("o_orderstatus").alias("kind")).where("src <> dst")
    g = e.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("  - "), "kind", F.lit(" -> "), F.col("dst").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    listed = g.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dst", "kind", line.alias("line")))), lambda x: x["line"]), "\n").alias("l"))
    return listed.select(F.col("src").alias("node"), F.concat(F.lit("- customer "), F.col("src").cast("string"), F.lit("\n"), "l").alias("block"))


@query("""select conv_id, role, turn, sha256(coalesce(text, '')) as text_sha256 from (select *, row_number() over (partition by conv_id, role order by turn desc, text) as r from conversations) where r = 1""")
def w02_latest_snapshot(spark, d):
    rows = relational.top_per_key(load(spark, d, "conversations"), ["conv_id", "role"], [F.desc("turn"), F.col("text")], 1)
    return rows.select("conv_id", "role", "turn", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
