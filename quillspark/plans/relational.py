"""Queries over the star schema and events: joins, aggregates, windows, sets, paging, facts, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, relational
from ..sources.tables import load
from .registry import query


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


@query("""select c_mktsegment, count(*) as n_lines, count(c_custkey) as n_known, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
from lineitem join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey and c_acctbal > 0 group by c_mktsegment""")
def j01_chunk_source_page_join(spark, d):
    c = load(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n_lines"), F.count("c_custkey").alias("n_known"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""with w as (select l_orderkey, l_linenumber, l_extendedprice as score from lineitem order by score desc, l_orderkey, l_linenumber limit 50)
select w.l_orderkey, w.l_linenumber, score, o_orderpriority, p_name from w join lineitem l on w.l_orderkey = l.l_orderkey and w.l_linenumber = l.l_linenumber join orders on w.l_orderkey = o_orderkey join part on l.l_partkey = p_partkey""")
def j02_hydrate_winners(spark, d):
    li = load(spark, d, "lineitem")
    top = li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score")).orderBy(F.desc("score"), "l_orderkey", "l_linenumber").limit(50)
    rows = top.join(li.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])
    rows = rows.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "score", "o_orderpriority", "p_name")


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def j04_semi_join(spark, d):
    o = load(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_semi")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def j05_anti_join(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name").join(load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("select o_orderkey from orders left join (select * from customer where c_acctbal >= 0) c on o_custkey = c_custkey where c_custkey is null")
def j06_orphans(spark, d):
    c = load(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, d, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_anti").select("o_orderkey")


@query("""with e as (select distinct l_suppkey as s, l_partkey + 1000000 as p from lineitem), u as (select s as node, p as other from e union all select p, s from e)
select node, count(*) as neighbors, min(other) as least from u group by node""")
def j10_undirected_neighbors(spark, d):
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    return relational.undirected(e).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("neighbors"), F.min("dst").alias("least"))


@query("""with m as (select c_custkey as id, c_nationkey as grp from customer union select s_suppkey, s_nationkey from supplier) select id, count(*) as groups from m group by id having count(*) > 1""")
def j11_membership_union(spark, d):
    m = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("grp")).union(load(spark, d, "supplier").select("s_suppkey", "s_nationkey")).distinct()
    return m.groupBy("id").agg(F.count("*").alias("groups")).where("groups > 1")


FACTS = "f as (select o_orderkey, o_custkey, o_orderstatus, o_orderdate, lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as valid_until from orders)"


def _facts(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return relational.validity(o, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query(f"with {FACTS} select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') as valid_from, strftime(valid_until, '%Y-%m-%d') as valid_until, case when valid_until is null then 'current' else 'superseded' end as status from f")
def w06_fact_validity(spark, d):
    return _facts(spark, d).select("o_orderkey", "o_custkey", _day("o_orderdate").alias("valid_from"), _day("valid_until").alias("valid_until"), "status")


@query(f"with {FACTS} select o_custkey, o_orderkey, o_orderstatus from f where o_orderdate <= timestamp '1996-01-01' and (valid_until is null or timestamp '1996-01-01' < valid_until)")
def j12_m03_as_of(spark, d):
    return relational.as_of(_facts(spark, d), "o_orderdate", F.expr("timestamp_ntz '1996-01-01 00:00:00'")).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"with {FACTS}, v as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from f) select o_custkey, version, o_orderkey, o_orderstatus from v")
def m04_version_history(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return _facts(spark, d).select("o_custkey", F.row_number().over(w).cast("long").alias("version"), "o_orderkey", "o_orderstatus")


@query("""with l as (select o_custkey, o_orderkey, o_totalprice, lag(o_totalprice) over w as previous, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select o_custkey, o_totalprice as latest, previous, case when previous is null then 'first' when o_totalprice > previous then 'up' when o_totalprice < previous then 'down' else 'same' end as direction from l where r = 1""")
def w08_previous_current(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = load(spark, d, "orders").select("o_custkey", "o_totalprice", F.lag("o_totalprice").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("nxt")).where("nxt is null")
    t, p = F.col("o_totalprice"), F.col("previous")
    return rows.select("o_custkey", t.alias("latest"), "previous", F.when(p.isNull(), "first").when(t > p, "up").when(t < p, "down").otherwise("same").alias("direction"))


@query("""with l as (select user_id, event_id, ts, event_type = 'signup' as snap from events), s as (select *, max(case when snap then ts end) over (partition by user_id) as last_snap from l)
select user_id, count(*) filter (last_snap is null or ts > last_snap) as since, count(*) as n from s group by user_id""")
def w09_counter_since_snapshot(spark, d):
    last = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(Window.partitionBy("user_id"))
    rows = load(spark, d, "events").select("user_id", "ts", last.alias("snap"))
    return rows.groupBy("user_id").agg(F.count_if(F.col("snap").isNull() | (F.col("ts") > F.col("snap"))).alias("since"), F.count("*").alias("n"))


@query("""with a as (select l_partkey as k, count(*) as h, round(sum(l_quantity), 2) as q from lineitem where l_shipdate < timestamp '1995-01-01' group by 1), b as (select l_partkey as k, count(*) as h, round(sum(l_quantity), 2) as q from lineitem where l_shipdate < timestamp '1996-01-01' group by 1)
select coalesce(a.k, b.k) as l_partkey, case when a.k is null then 'added' when b.k is null then 'deleted' when a.q = b.q then 'unchanged' else 'modified' end as action from a full join b on a.k = b.k""")
def j16_snapshot_delta(spark, d):
    li = load(spark, d, "lineitem")
    cut = lambda day: li.where(F.col("l_shipdate") < F.expr(f"timestamp_ntz '{day} 00:00:00'")).groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    return relational.snapshot_delta(cut("1995-01-01"), cut("1996-01-01"), "l_partkey", "q")


@query("""with a as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 0), b as (select doc_id, sha256(text) as h from documents where doc_id % 2 = 1),
d as (select h, min(doc_id) as old from a group by h having count(*) = 1), e as (select h, min(doc_id) as new from b group by h having count(*) = 1) select old, new from d join e using (h)""")
def j17_renames(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return relational.renames(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "h")


@query("""with s as (select l_orderkey, list_sort(list_distinct(list(l_partkey))) as s from lineitem group by 1 having count(distinct l_partkey) between 2 and 50),
x as (select l_orderkey, unnest(s) as p from s) select a.p as a, b.p as b, count(*) as n from x a join x b on a.l_orderkey = b.l_orderkey and a.p < b.p group by all""")
def j14_cochange_pairs(spark, d):
    return relational.pairs_in_group(load(spark, d, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey")


@query("""select c.c_nationkey, count(distinct c_custkey) as customers, count(distinct o_orderkey) as orders, count(distinct o_custkey) as active from customer c left join orders on c_custkey = o_custkey group by c_nationkey""")
def j18_coverage_counts(spark, d):
    per = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("k"))
    rows = load(spark, d, "customer").select("c_custkey", "c_nationkey").distinct().join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.coalesce(F.sum("k"), F.lit(0)).alias("orders"), F.count("o_custkey").alias("active"))


@query("""with u as (select o_custkey as id, 1 as grp, o_orderkey as k from orders where o_orderpriority = '1-URGENT' union all select o_custkey, 2, o_orderkey from orders where o_totalprice > 150000 union all select c_custkey, 3, 0 from customer)
select id, grp from (select id, grp, row_number() over (partition by id order by grp, k) as r from u) where r = 1""")
def j20_dedup_ranked_groups(spark, d):
    o = load(spark, d, "orders")
    u = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.lit(1).alias("grp")).unionByName(o.where("o_totalprice > 150000").select(F.col("o_custkey").alias("id"), F.lit(2).alias("grp"))).unionByName(load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(3).alias("grp")))
    return u.groupBy("id").agg(F.min("grp").alias("grp"))


@query("""with r as (select l_orderkey as g, l_linenumber as k, cast(l_quantity as int) as a, cast(l_quantity as int) + l_linenumber as b from lineitem)
select x.g as order_key, x.k as left_line, y.k as right_line from r x join r y on x.g = y.g and x.k < y.k and x.a <= y.b and y.a <= x.b""")
def j21_interval_overlap(spark, d):
    r = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("int").alias("a"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("b"))
    x, y = r.select("g", *(F.col(c).alias(f"x{c}") for c in "kab")), r.select("g", *(F.col(c).alias(f"y{c}") for c in "kab"))
    return x.join(y, "g").where("xk < yk and xa <= yb and ya <= xb").select(F.col("g").alias("order_key"), F.col("xk").alias("left_line"), F.col("yk").alias("right_line"))


@query("select l_returnflag, l_linestatus, count(*) as n from lineitem group by all")
def g01_count_by_key(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""select l_suppkey, count(*) filter (l_returnflag = 'R') as returned, count(*) filter (l_discount > 0.05) as discounted, count(*) as n from lineitem group by 1""")
def g02_conditional_counts(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count("*").alias("n"))


@query("select o_orderpriority, count(distinct o_custkey) as customers, count(distinct l_partkey) as parts from orders join lineitem on o_orderkey = l_orderkey group by 1")
def g03_distinct_across_join(spark, d):
    j = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey").join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    return j.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("l_partkey").alias("parts"))


@query("select l_partkey, count(*) as n, round(avg(l_quantity), 4) as mean from lineitem group by 1 having count(*) >= 20")
def g04_having(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean")).where("n >= 20")


@query("select c_nationkey, string_agg(distinct c_mktsegment, ',' order by c_mktsegment) as segments from customer group by 1")
def g14_string_aggregation(spark, d):
    return load(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@query("""with e as (select distinct l_suppkey as s, l_partkey + 1000000 as p from lineitem) select node, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from (select s as node, 0 as i, 1 as o from e union all select p, 1, 0 from e) group by node""")
def g16_r07_degrees(spark, d):
    return graph.degrees(load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")))


@query("""with s as (select l_partkey, l_suppkey, count(*) as n, round(sum(l_quantity), 2) as qty, max(l_shipdate) as last from lineitem group by 1, 2)
select l_partkey, l_suppkey, n, qty, strftime(last, '%Y-%m-%d') as last, round(n / sum(n) over (partition by l_partkey), 6) as share from s""")
def g17_w15_signals_share(spark, d):
    s = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), _day(F.max("l_shipdate")).alias("last"))
    return s.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("l_partkey")), 6))


@query("""select event_type, quantile_disc(value, 0.95) as p95, round(avg(value), 4) as mean, min(value) as least, max(value) as most, count(*) as n from events group by 1""")
def g28_g29_latency_stats(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("""select count(*) as n, strftime(max(ts), '%Y-%m-%d') as last, max(event_id) as top, md5(concat_ws('|', count(*), max(event_id), max(user_id))) as fingerprint from events""")
def g35_revision_fingerprint(spark, d):
    return load(spark, d, "events").agg(F.count("*").alias("n"), _day(F.max("ts")).alias("last"), F.max("event_id").alias("top"), F.md5(F.concat_ws("|", F.count("*").cast("string"), F.max("event_id").cast("string"), F.max("user_id").cast("string")).cast("binary")).alias("fingerprint"))


@query("""select o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1""")
def w01_latest_per_key(spark, d):
    return relational.top_per_key(load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", _day("o_orderdate").alias("day"))


@query("""select event_id, user_id, rank from (select event_id, user_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rank from events) where rank > 20""")
def w03_beyond_keep_n(spark, d):
    return relational.beyond_per_key(load(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("event_id", "user_id", "rank")


@query("""select l_suppkey, l_orderkey, l_linenumber, r from (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as r from lineitem) where r <= 256""")
def w04_bounded_candidates(spark, d):
    return relational.top_per_key(load(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], [F.col("l_orderkey"), F.col("l_linenumber")], 256, "r")


@query("""select n_name, n, (select count(*) from nation) as total from (select n_name, count(c_custkey) as n from nation left join customer on n_nationkey = c_nationkey group by 1)""")
def w05_total_over_all(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", "n_name")
    per = n.join(load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))
    return per.crossJoin(F.broadcast(n.agg(F.count("*").alias("total"))))  # a one-row side


@query("select event_id, user_id, value from events where value < 50 or (value = 50 and event_id < 100) order by value desc, event_id desc limit 100")
def k07_keyset_page(spark, d):
    return relational.keyset_page(load(spark, d, "events").select("event_id", "user_id", "value"), "value", "event_id", (50.0, 100), 100)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 50 offset 100")
def k08_offset_page(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


@query("""select p_partkey, p_name, place from (select p_partkey, p_name, case when lower(p_name) = 'part' then 0 when starts_with(lower(p_name), 'part') then 1 else 2 end as place from part where contains(lower(p_name), 'a')) order by place, length(p_name), p_partkey limit 40""")
def k14_fuzzy_search(spark, d):
    low = F.lower("p_name")
    rows = load(spark, d, "part").where(low.contains("a")).select("p_partkey", "p_name", F.when(low == "part", 0).when(low.startswith("part"), 1).otherwise(2).alias("place"))
    return rows.orderBy("place", F.length("p_name"), "p_partkey").limit(40)


@query("""select kind, strftime(moment, '%Y-%m') as month, count(*) as n from (select 'order' as kind, o_orderdate as moment from orders union all select 'ship', l_shipdate from lineitem union all select event_type, ts from events) group by all""")
def u01_g34_activity_union(spark, d):
    u = load(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderdate").alias("at")).unionByName(load(spark, d, "lineitem").select(F.lit("ship").alias("kind"), F.col("l_shipdate").alias("at"))).unionByName(load(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").alias("at")))
    return u.groupBy("kind", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""select l_partkey, 'both' as side from (select l_partkey from lineitem where l_returnflag = 'R' intersect select l_partkey from lineitem where l_returnflag = 'A')
union all select l_partkey, 'only_r' from (select l_partkey from lineitem where l_returnflag = 'R' except select l_partkey from lineitem where l_returnflag = 'A')""")
def u04_intersect_except(spark, d):
    li = load(spark, d, "lineitem")
    r, a = (li.where(F.col("l_returnflag") == x).select("l_partkey") for x in "RA")
    return r.intersect(a).withColumn("side", F.lit("both")).unionByName(r.subtract(a).withColumn("side", F.lit("only_r")))


@query("""select coalesce(s.k, w.k) as custkey, case when s.k is null then 'insert' when w.k is null then 'retract' else 'keep' end as action
from (select distinct o_custkey as k from orders where o_orderdate < timestamp '1995-01-01') s full join (select distinct o_custkey as k from orders where o_orderdate >= timestamp '1995-01-01') w on s.k = w.k""")
def u07_retract_missing(spark, d):
    o, cut = load(spark, d, "orders"), F.expr("timestamp_ntz '1995-01-01 00:00:00'")
    s = o.where(F.col("o_orderdate") < cut).select(F.col("o_custkey").alias("custkey")).distinct().withColumn("s", F.lit(1))
    w = o.where(F.col("o_orderdate") >= cut).select(F.col("o_custkey").alias("custkey")).distinct().withColumn("w", F.lit(1))
    return s.join(w, "custkey", "full_outer").select("custkey", F.when(F.col("s").isNull(), "insert").when(F.col("w").isNull(), "retract").otherwise("keep").alias("action"))


@query("""select event_id from events where (event_type = 'error' and ts < (select max(ts) from events) - interval 7 day) or (event_type = 'view' and ts < (select max(ts) from events) - interval 30 day)""")
def f14_retention(spark, d):
    e = load(spark, d, "events")
    rows = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # a one-row side
    old = lambda kind, days: (F.col("event_type") == kind) & (F.col("ts") < F.col("now") - F.expr(f"interval {days} days"))
    return rows.where(old("error", 7) | old("view", 30)).select("event_id")


@query("""select user_id, cast(epoch(time_bucket(interval 1 hour, ts)) as bigint) as start, count(*) as n, count(*) > 5 as over from events group by all""")
def t02_rate_windows(spark, d):
    from ..streaming.windows import rate_windows

    rows = rate_windows(load(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.unix_timestamp("start").alias("start"), "n", "over")


@query("""with recursive e as (select distinct l_suppkey as a, l_partkey + 1000000 as b from lineitem where l_quantity > 49), u as (select a, b from e union select b, a from e),
w as (select 1::bigint as node, 0::bigint as dist union select u.b, w.dist + 1 from w join u on w.node = u.a where w.dist < 4) select node, min(dist) as dist from w group by node""")
def r03_r04_distances(spark, d):
    e = load(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))
    return graph.distances(relational.undirected(e), spark.range(1, 2).select(F.col("id").alias("node")), 4)


@query("""with recursive e as (select distinct l_orderkey as a, l_partkey + 10000000 as b from lineitem where l_quantity > 49.5), u as (select a, b from e union select b, a from e),
w as (select distinct a as node, a as low from u union select u.b, w.low from w join u on w.node = u.a where w.low < u.b) select node, min(low) as component from w group by node""")
def r09_components(spark, d):
    e = load(spark, d, "lineitem").where("l_quantity > 49.5").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10000000).alias("dst"))
    return graph.components(e)


#: Parts' nodes in the graphs over whole tables stand above all numbers of suppliers, and orders' nodes above those.
PARTS, ORDERS, CUSTOMERS = 10**12, 2 * 10**12, 3 * 10**12


@query(f"""with recursive h as materialized (select distinct l_suppkey as a, l_partkey + {PARTS} as b from lineitem), e as materialized (select a, b from h union select b, a from h),
s as (select cast(1 as bigint) as node, cast(0 as bigint) as dist union select e.b, dist + 1 from s join e on e.a = s.node where dist < 6) select node, min(dist) as dist from s group by node""")
def r03_r04_all_distances(spark, d):
    """Steps from supplier 1, up to 6, over the undirected supplier-part edges of all of lineitem."""
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PARTS).alias("dst"))
    return graph.distances(relational.undirected(e), spark.range(1, 2).select(F.col("id").alias("node")), 6)


def _least_sql(rounds: int) -> str:
    """Least labels spread along the edges, a table a round, each followed by a jump to the label's label."""
    steps = "".join(
        f""",
m{k + 1} as materialized (select l.node, least(any_value(l.label), min(n.label)) as label from l{k} l join e on a = l.node join l{k} n on n.node = b group by l.node),
l{k + 1} as materialized (select m.node, j.label from m{k + 1} m join m{k + 1} j on j.node = m.label)"""
        for k in range(rounds)
    )
    return f"""with h as materialized (select distinct l_orderkey as a, l_partkey + {PARTS} as b from lineitem), e as materialized (select a, b from h union select b, a from h),
l0 as materialized (select distinct a as node, a as label from e){steps} select node, label as component from l{rounds}"""


@query(_least_sql(12))
def r09_all_components(spark, d):
    """Components over the order-part edges of all of lineitem."""
    e = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + PARTS).alias("dst"))
    return graph.components(e)


@query(f"""with e as materialized (select distinct src, dst from (select l_partkey + {PARTS} as src, l_suppkey as dst from lineitem union all select l_orderkey + {ORDERS}, l_partkey + {PARTS} from lineitem
  union all select o_custkey + {CUSTOMERS}, o_orderkey + {ORDERS} from orders) where src <> dst),
b as materialized (select distinct x.src, y.dst from e x join e y on x.dst = y.src), c as materialized (select distinct x.src, b.dst from e x join b on x.dst = b.src)
select dst as node, count(*) as reached from (select src, dst from e union select src, dst from b union select src, dst from c) where src <> dst group by dst""")
def r13_all_blast_radius(spark, d):
    """What depends on each supplier, part and order in up to 3 inbound steps: customers on orders, orders on parts, parts on suppliers."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    e = li.select((F.col("l_partkey") + PARTS).alias("src"), F.col("l_suppkey").alias("dst"))
    e = e.unionByName(li.select((F.col("l_orderkey") + ORDERS).alias("src"), (F.col("l_partkey") + PARTS).alias("dst")))
    e = e.unionByName(load(spark, d, "orders").select((F.col("o_custkey") + CUSTOMERS).alias("src"), (F.col("o_orderkey") + ORDERS).alias("dst")))
    return graph.blast_radius(e, 3)


_REACH = f"""with e as materialized (select distinct src, dst from (select l_partkey + {PARTS} as src, l_suppkey as dst from lineitem union all select l_orderkey + {ORDERS}, l_partkey + {PARTS} from lineitem
  union all select o_custkey + {CUSTOMERS}, o_orderkey + {ORDERS} from orders) where src <> dst),
b as materialized (select distinct x.src, y.dst from e x join e y on x.dst = y.src), c as materialized (select distinct x.src, b.dst from e x join b on x.dst = b.src),
n as (select dst as node, count(*) as reached from (select src, dst from e union select src, dst from b union select src, dst from c) where src <> dst group by dst)"""
MOST_REACHED = 160


def _dependencies(spark, d):
    """Customers on orders, orders on parts, parts on suppliers."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    e = li.select((F.col("l_partkey") + PARTS).alias("src"), F.col("l_suppkey").alias("dst"))
    e = e.unionByName(li.select((F.col("l_orderkey") + ORDERS).alias("src"), (F.col("l_partkey") + PARTS).alias("dst")))
    return e.unionByName(load(spark, d, "orders").select((F.col("o_custkey") + CUSTOMERS).alias("src"), (F.col("o_orderkey") + ORDERS).alias("dst")))


@query(f"{_REACH} select node, least(reached, {MOST_REACHED}) as reached, reached > {MOST_REACHED} as truncated from n")
def r13_bounded_blast_radius(spark, d):
    """What depends on each supplier, part and order in up to 3 inbound steps, counted up to a limit."""
    return graph.bounded_reach(_dependencies(spark, d), 3, MOST_REACHED)


@query()
def r13_reach_estimates(spark, d):
    """About how many nodes depend on each supplier, part and order in up to 3 inbound steps, without a limit."""
    return graph.reach_estimates(_dependencies(spark, d), 3)


NATION_EDGES = """select distinct src, dst from (select o_orderkey + 10000000 as src, o_custkey + 1000 as dst from orders
  union all select c_custkey + 1000, c_nationkey from customer) where src <> dst"""


def _rank_sql(edges: str = NATION_EDGES, iterations: int = 20, damping: float = 0.85) -> str:
    """Every step of the ranking as a table of its own."""
    steps = "".join(
        f""",
r{k + 1} as materialized (select node, loose, {1 - damping}::double / n + {damping}::double * (coalesce(got, 0) + (select coalesce(sum(rank), 0) from r{k} where loose) / n) as rank
  from node left join (select dst as node, sum(rank * share) as got from link join r{k} on src = node group by dst) using (node), size)"""
        for k in range(iterations)
    )
    return f"""with e as materialized ({edges}),
link as materialized (select src, dst, 1.0::double / count(*) over (partition by src) as share from e),
node as materialized (select node, node not in (select src from e) as loose from (select src as node from e union select dst from e)),
size as materialized (select count(*) as n from node),
r0 as materialized (select node, loose, 1.0::double / n as rank from node, size){steps}
select node, round(rank, 12) as rank from r{iterations}"""


@query(_rank_sql())
def r06_pagerank(spark, d):
    """Rank over orders -> customers -> nations."""
    o = load(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("src"), (F.col("o_custkey") + 1000).alias("dst"))
    c = load(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return graph.pagerank(o.unionByName(c))


@query("""select o_custkey, count(*) filter (l_returnflag = 'R') > 0 as hit, count(*) as n, round(max(l_extendedprice), 2) as top, round(sum(case when r <= 4 then case when r = 1 then l_extendedprice else 0.2 * l_extendedprice end else 0 end), 2) as score
from (select o_custkey, l_returnflag, l_extendedprice, row_number() over (partition by o_custkey order by l_extendedprice desc, l_orderkey, l_linenumber) as r from orders join lineitem on o_orderkey = l_orderkey) group by o_custkey""")
def g20_peak_plus_support(spark, d):
    j = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_extendedprice"), "o_orderkey")
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("l_extendedprice"), "o_orderkey", "l_linenumber"))
    part = F.when(F.col("r") == 1, F.col("l_extendedprice")).when(F.col("r") <= 4, 0.2 * F.col("l_extendedprice")).otherwise(0.0)
    return j.withColumn("r", r).groupBy("o_custkey").agg((F.count_if(F.col("l_returnflag") == "R") > 0).alias("hit"), F.count("*").alias("n"), F.round(F.max("l_extendedprice"), 2).alias("top"), F.round(F.sum(part), 2).alias("score"))


@query("""with s as (select o_custkey, count(*) as n, sum(o_totalprice) as total, avg(o_totalprice) as mean, min(o_orderdate) as first, max(o_orderdate) as last, count(distinct o_orderstatus) as units from orders group by 1)
select o_custkey, case when units = 1 then 'single' else 'mixed' end as kind, round(total, 2) as total, round(mean, 6) as mean, case when n = 2 then datediff('day', first, last) end as days from s""")
def g22_g23_reducers(spark, d):
    s = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.avg("o_totalprice").alias("mean"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count_distinct("o_orderstatus").alias("units"))
    return s.select("o_custkey", F.when(F.col("units") == 1, "single").otherwise("mixed").alias("kind"), F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), F.when(F.col("n") == 2, F.datediff("last", "first").cast("long")).alias("days"))
