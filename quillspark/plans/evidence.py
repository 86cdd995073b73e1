"""Queries over questions, claims, evidence, clusters and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import text as T
from ..functions.embedding import hash_embedding
from ..operators import lexical, relational, vector
from ..sources.tables import load
from .registry import query
from .retrieval import BM25, CEN, VEC, _vectors
from .text import KEY, TOK

SENT = "list_filter(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(9246), 'g'), chr(9246)), lambda x: x <> '')"


@query("select doc_id, source, n_chars from documents where lang in ('en', 'fr') and n_chars between 300 and 5000 and contains(lower(text), 'the') and source like 'src1%' and source is not null")
def f03_f04_source_filter(spark, d):
    low = F.lower("text")
    return load(spark, d, "documents").where(F.col("lang").isin("en", "fr") & F.col("n_chars").between(300, 5000) & low.contains("the") & F.col("source").startswith("src1")).select("doc_id", "source", "n_chars")


@query("select doc_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(lower(coalesce(text, '')), '{p}') then '{k}' end" for k, p in C.SENSITIVE.items()) + "], lambda x: x is not null), ',') as categories, " + " or ".join(f"contains(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'), '{p}')" for p in C.STEERING) + " as hostile from documents")
def f06_f12_gates(spark, d):
    return load(spark, d, "documents").select("doc_id", F.array_join(C.sensitive_categories(F.col("text")), ",").alias("categories"), C.steering(F.col("text")).alias("hostile"))


@query("select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{p}') then '{n}'" for n, p in C.OPERATIONS) + " else 'direct_lookup' end as operation from conversations where role = 'user'")
def f17_query_planner(spark, d):
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", C.operation(F.col("text")).alias("operation"))


@query("select c_nationkey, count(*) filter (c_nationkey is distinct from s_nationkey) as mismatched, count(*) as n from customer left join supplier on c_custkey = s_suppkey group by c_nationkey")
def f21_c10_null_safe_membership(spark, d):
    j = load(spark, d, "customer").join(load(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    return j.groupBy("c_nationkey").agg(F.count_if(~F.col("c_nationkey").eqNullSafe(F.col("s_nationkey"))).alias("mismatched"), F.count("*").alias("n"))


@query("select o_orderkey, (select count(*) from lineitem where l_orderkey = o_orderkey) as lines, (select count(distinct l_suppkey) from lineitem where l_orderkey = o_orderkey) as suppliers from orders")
def f22_scalar_subqueries(spark, d):
    per = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"))
    return load(spark, d, "orders").select("o_orderkey").join(per, "o_orderkey", "left").na.fill(0)


@query(f"""
with n as (select source, count(*) as n from documents group by source),
e as (select source, term, count(*) as df from (select source, unnest(list_distinct({KEY})) as term from documents) group by all),
prof as (select r.source, term, round(df / n, 6) as weight from (select *, row_number() over (partition by source order by df desc, term) as rank from e) r join n on r.source = n.source where rank <= 32),
q as (select distinct item_id, unnest({KEY}) as term from benchmark), s as (select item_id, source, round(sum(weight), 4) as score from q join prof using (term) group by all)
select item_id, source, score, rank from (select *, row_number() over (partition by item_id order by score desc, source) as rank from s) where rank <= 3""")
def j03_c01_shortlist(spark, d):
    profile = lexical.term_profile(load(spark, d, "documents"), "source")
    q = load(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("term"))
    s = q.join(profile, "term").groupBy("item_id", "source").agg(F.round(F.sum("weight"), 4).alias("score"))
    return relational.top_per_key(s, ["item_id"], [F.desc("score"), F.col("source")], 3).select("item_id", "source", "score", "rank")


@query("""with ch as (select l_partkey, l_linenumber from lineitem where l_shipdate >= timestamp '1998-01-01'), cov as (select l_suppkey, l_partkey, l_linenumber from lineitem where l_returnflag = 'A')
select l_suppkey, count(distinct (cov.l_partkey, cov.l_linenumber)) as hits from cov join ch on cov.l_partkey = ch.l_partkey and cov.l_linenumber = ch.l_linenumber group by 1""")
def j13_change_coverage(spark, d):
    li = load(spark, d, "lineitem")
    changed = li.where(F.col("l_shipdate") >= F.expr("timestamp_ntz '1998-01-01 00:00:00'")).select("l_partkey", "l_linenumber").distinct()
    cov = li.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    return cov.join(changed, ["l_partkey", "l_linenumber"]).groupBy("l_suppkey").agg(F.count("*").alias("hits"))


@query("""select e.event_id, case when o.o_orderkey is null then 'source_deleted' when o.o_totalprice < 50000 then 'source_reindexed' else 'current' end as state from events e left join orders o on e.event_id = o.o_orderkey""")
def j19_citation_state(spark, d):
    j = load(spark, d, "events").select("event_id").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit(True).alias("live"), "o_totalprice"), "event_id", "left")
    return j.select("event_id", F.when(F.col("live").isNull(), "source_deleted").when(F.col("o_totalprice") < 50000, "source_reindexed").otherwise("current").alias("state"))


@query("""with h as (select source, lang, count(*) as n from documents group by all) select source, string_agg(lang || '=' || n, ',' order by lang) as histogram, cast(sum(n) as bigint) as n from h group by source""")
def g12_type_distribution(spark, d):
    h = load(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return h.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "lang", F.col("n").cast("string")))), ",").alias("histogram"), F.sum("n").alias("n"))


@query(f"""with t as (select distinct conv_id, turn, unnest({KEY}) as topic from conversations where role = 'user') select topic, count(distinct conv_id) as sessions, max((conv_id, turn)).conv_id as latest from (select topic, conv_id, turn from t) group by topic having count(distinct conv_id) >= 2""".replace("max((conv_id, turn)).conv_id", "max(conv_id)"))
def g19_shared_topics(spark, d):
    t = load(spark, d, "conversations").where("role = 'user'").select("conv_id", F.explode(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("topic")).distinct()
    return t.groupBy("topic").agg(F.count("*").alias("sessions"), F.max("conv_id").alias("latest")).where("sessions >= 2")


@query("select p_brand, count(distinct lower(trim(p_type))) as kinds, case when count(*) = 1 then max(p_size) else count(distinct p_size) end::bigint as sizes from part group by p_brand")
def g21_g25_distinct_counts(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.count_distinct(F.lower(F.trim("p_type"))).alias("kinds"), F.when(F.count("*") == 1, F.max("p_size")).otherwise(F.count_distinct("p_size")).cast("long").alias("sizes"))


@query("select user_id, arg_min(event_type, (ts, event_id)) as first, arg_max(event_type, (ts, event_id)) as last, count(*) as n from events group by user_id")
def g24_first_last_event(spark, d):
    at = F.struct("ts", "event_id")
    return load(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first"), F.max_by("event_type", at).alias("last"), F.count("*").alias("n"))


@query(f"""with {VEC}, g as (select q.vec_id as query_id, q.label, c.vec_id as id from embeddings q join embeddings c on q.label = c.label and q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
n as (select query_id, label, count(*) as gold from g group by all), f as (select r.query_id, count(*) as found from r join g on r.query_id = g.query_id and r.id = g.id where rank <= 10 group by 1)
select label, count(*) as questions, round(avg(coalesce(found, 0) / least(gold, 10)), 6) as recall, round(avg(case when found > 0 then 1.0 else 0.0 end), 6) as any_hit from n left join f using (query_id) group by label""")
def g27_recall_by_category(spark, d):
    e, v = load(spark, d, "embeddings").select("vec_id", "label"), _vectors(spark, d)
    size = e.groupBy("label").agg((F.count("*") - 1).alias("gold"))
    hits = vector.top_k(v.where("id % 20 = 0"), v, k=10).join(e.select(F.col("vec_id").alias("id"), "label"), "id").join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    found = hits.where("label = own").groupBy("query_id").agg(F.count("*").alias("found"))
    q = e.where("vec_id % 20 = 0").join(size, "label").where("gold > 0").join(found.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    return q.groupBy("label").agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce("found", F.lit(0)) / F.least("gold", F.lit(10))), 6).alias("recall"), F.round(F.avg(F.when(F.col("found") > 0, 1.0).otherwise(0.0)), 6).alias("any_hit"))


@query("select count(*) as vectors, cast(max(len(embedding)) as bigint) as dims, cast(sum(len(embedding) * 4) as bigint) as exact_bytes, cast(sum(ceil(len(embedding) * 4 / 8.0)) as bigint) as four_bit_bytes from embeddings")
def g32_index_cost(spark, d):
    n = F.size("embedding")
    return load(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.max(n).cast("long").alias("dims"), F.sum(n * 4).alias("exact_bytes"), F.sum(F.ceil(n * 4 / 8.0)).cast("long").alias("four_bit_bytes"))


@query("""select role, count(*) as turns, cast(coalesce(sum(length(text)), 0) as bigint) as before, cast(coalesce(sum(least(length(text), 400)), 0) as bigint) as after, round(case when sum(length(text)) > 0 then 100.0 * (1 - sum(least(length(text), 400)) / sum(length(text))) else 0 end, 4) as reduction from conversations group by role""")
def g37_packing_diagnostics(spark, d):
    n = F.length("text")
    before, after = F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.least(n, F.lit(400))), F.lit(0))
    return load(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), before.alias("before"), after.alias("after"), F.round(F.when(before > 0, 100.0 * (1 - after / before)).otherwise(0.0), 4).alias("reduction"))


@query("select source, count(distinct doc_id) as considered, count(*) filter (n_chars >= 500) as analyzed, count(*) filter (n_chars < 200) as low_relevance, round(avg(case when n_chars < 500 then 1.0 else 0.0 end), 6) as low_trust from documents group by source")
def g38_g39_coverage_ledger(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count_distinct("doc_id").alias("considered"), F.count_if(F.col("n_chars") >= 500).alias("analyzed"), F.count_if(F.col("n_chars") < 200).alias("low_relevance"), F.round(F.avg(F.when(F.col("n_chars") < 500, 1.0).otherwise(0.0)), 6).alias("low_trust"))


@query("""select count(*) filter (quality = 1 and toxic = 0) as wins, count(*) filter (quality = 0 and toxic = 1) as losses, count(*) filter (quality = 1 and toxic = 1) as both, count(*) filter (quality = 0 and toxic = 0) as neither, count(*) as n from documents join labels using (doc_id)""")
def g40_paired_comparison(spark, d):
    j = load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id")
    c = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    return j.agg(c(1, 0).alias("wins"), c(0, 1).alias("losses"), c(1, 1).alias("both"), c(0, 0).alias("neither"), F.count("*").alias("n"))


@query(f"""with {BM25}, v as (select a.vec_id as item_id, b.vec_id as doc_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as s from embeddings a, embeddings b where a.vec_id in (select item_id from benchmark)),
h as (select r.item_id, r.doc_id, round(0.7 * greatest(coalesce(s, 0), 0) + 0.3 * score, 4) as score from ranked r left join v on r.item_id = v.item_id and r.doc_id = v.doc_id where rank <= 50)
select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from h) where rank <= 5""")
def k04_hybrid_topk(spark, d):
    """Of each item's 50 best by BM25 the five best by 0.7 vector + 0.3 lexical score: score thin, then hydrate."""
    base = lexical.bm25(load(spark, d, "documents"), load(spark, d, "benchmark"), k=50).drop("rank")
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    j = base.join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("u")), "item_id", "left").join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), "doc_id", "left")
    s = F.greatest(F.coalesce(F.round(vector.dot(F.col("u"), F.col("v")), 6), F.lit(0.0)), F.lit(0.0))
    scored = j.select("item_id", "doc_id", F.round(0.7 * s + 0.3 * F.col("score"), 4).alias("score"))
    return relational.top_per_key(scored, ["item_id"], [F.desc("score"), F.col("doc_id")], 5)


@query(f"""with {VEC}, p as (select r.query_id, r.id, i, max(list_dot_product(q.embedding[i * 8 + 1:i * 8 + 8]::double[], c.embedding[j * 8 + 1:j * 8 + 8]::double[])) as m from r join embeddings q on r.query_id = q.vec_id join embeddings c on r.id = c.vec_id, (select unnest(range(8)) as i) a, (select unnest(range(8)) as j) b where rank <= 20 group by all),
t as (select query_id, id, round(sum(m), 4) as score from p group by all)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by score desc, id) as rank from t) where rank <= 5""")
def k17_late_interaction(spark, d):
    """The 20 nearest of each query re-ranked by the sum of best matches of its eight parts."""
    v = _vectors(spark, d)
    hits = vector.top_k(v.where("id % 20 = 0"), v, k=20).select("query_id", "id")
    j = hits.join(v.select(F.col("id").alias("query_id"), F.col("v").alias("u")), "query_id").join(v, "id")
    parts = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(c, i * 8 + 1, 8))
    best = F.transform(parts(F.col("u")), lambda a: F.array_max(F.transform(parts(F.col("v")), lambda b: vector.dot(a, b))))
    scored = j.select("query_id", "id", F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), 4).alias("score"))
    return relational.top_per_key(scored, ["query_id"], [F.desc("score"), F.col("id")], 5)


@query(f"""with s as (select doc_id, unnest(list_transform({SENT}, lambda x, i: {{'x': x, 'i': i}})) as s from documents),
c as (select doc_id, s.i - 1 as place, 10 * len(list_distinct(regexp_extract_all(lower(s.x), '(?:the|and|that)'))) + least(length(s.x) / 40.0, 5) as score, length(s.x) as chars from s)
select doc_id, place, round(score, 4) as score, rank from (select *, row_number() over (partition by doc_id order by round(score, 4) desc, place) as rank from c) where rank <= 3""")
def k11_salient_sentences(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "x"))
    hits = F.size(F.array_distinct(F.regexp_extract_all(F.lower("x"), F.lit("(?:the|and|that)"), 0)))
    scored = rows.select("doc_id", F.col("i").cast("long").alias("place"), F.round(10 * hits + F.least(F.length("x") / 40.0, F.lit(5.0)), 4).alias("score"))
    return relational.top_per_key(scored, ["doc_id"], [F.desc("score"), F.col("place")], 3).select("doc_id", "place", "score", "rank")


@query("""select event_id, event_type, place from (select event_id, event_type, case event_type when 'error' then 0 when 'purchase' then 1 else 2 end as place, ts from events) order by place, ts, event_id limit 200""")
def k09_priority_order(spark, d):
    place = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    return load(spark, d, "events").select("event_id", "event_type", place.alias("place"), "ts").orderBy("place", "ts", "event_id").limit(200).drop("ts")


@query("""with r as (select c_custkey as k, c_nationkey as grp, c_acctbal as s from customer union all select s_suppkey, s_nationkey, s_acctbal from supplier) select k, grp, round(s / max(s) over (partition by grp), 6) as norm from r""")
def w10_normalize_by_max(spark, d):
    r = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("s")).unionByName(load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("s")))
    top = r.groupBy("grp").agg(F.max("s").alias("top"))
    return r.join(top, "grp").select("k", "grp", F.round(F.col("s") / F.col("top"), 6).alias("norm"))


@query("""select kind, id, strftime(moment, '%Y-%m-%d') as day from (select 'order' as kind, o_orderkey as id, o_orderdate as moment from orders where o_orderstatus = 'O' union all select 'event', event_id, ts from events where event_type = 'error')""")
def u02_timeline_union(spark, d):
    o = load(spark, d, "orders").where("o_orderstatus = 'O'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("m"))
    e = load(spark, d, "events").where("event_type = 'error'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("m"))
    return o.unionByName(e).select("kind", "id", F.date_format("m", "yyyy-MM-dd").alias("day"))


@query(None)
def x02_hash_embedding(spark, d):
    """128-dimensional signed hash embedding of every document; tested against plain Python."""
    return load(spark, d, "documents").select("doc_id", hash_embedding()(F.col("text")).alias("v")).select("doc_id", F.transform("v", lambda x: F.round(x, 6)).alias("embedding"))


@query("""select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '''s\\b', '', 'g'), '^(the|a|an) ', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as topic from part""")
def x17_topic_keys(spark, d):
    return load(spark, d, "part").select("p_partkey", C.topic_key(F.col("p_name")).alias("topic"))


@query("""with q as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]{1,3}(?:,[0-9]{3})+(?:\\.[0-9]+)?|[0-9]+(?:\\.[0-9]+)?'), lambda x: cast(replace(x, ',', '') as double)) as q,
  list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}'), lambda x: replace(x, '/', '-')), lambda x: try_strptime(x, '%Y-%m-%d') is not null) as dts from documents)
select doc_id, cast(len(q) as bigint) as n_quantities, coalesce(list_max(q), 0)::double as largest, cast(len(dts) as bigint) as n_dates, coalesce(list_min(dts), '') as earliest from q""")
def x21_x22_quantities_dates(spark, d):
    q, dates = C.quantities(F.col("text")), C.iso_dates(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(q).cast("long").alias("n_quantities"), F.coalesce(F.array_max(q), F.lit(0.0)).alias("largest"), F.size(dates).cast("long").alias("n_dates"), F.coalesce(F.array_min(dates), F.lit("")).alias("earliest"))


@query(f"""with a as (select conv_id, turn, text, lead(text) over (partition by conv_id order by turn) as reply, lead(role) over (partition by conv_id order by turn) as who from conversations),
t as (select conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{4,}}')) as x, list_distinct(regexp_extract_all(lower(coalesce(reply, '')), '[a-z0-9]{{4,}}')) as y from a where who = 'assistant')
select conv_id, turn, cast(len(list_intersect(x, y)) as bigint) as shared, case when len(list_intersect(x, y)) >= 3 then 'grounded' when len(list_intersect(x, y)) > 0 then 'partial' else 'ungrounded' end as quality from t""")
def x40_response_grounding(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("reply"), F.lead("role").over(w).alias("who")).where("who = 'assistant'")
    n = F.size(F.array_intersect(C.key_terms(F.col("text")), C.key_terms(F.col("reply"))))
    return rows.select("conv_id", "turn", n.cast("long").alias("shared"), F.when(n >= 3, "grounded").when(n > 0, "partial").otherwise("ungrounded").alias("quality"))


@query("""with l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'x': x, 'i': i})) as l from documents where contains(text, '|')),
c as (select doc_id, l.i - 1 as line, unnest(list_transform(string_split(l.x, '|'), lambda x, i: {'x': trim(x, ' '), 'i': i})) as c from l where contains(l.x, '|'))
select doc_id, line, c.i - 1 as col, c.x as cell from c where c.x <> ''""")
def x38_table_cells(spark, d):
    lines = load(spark, d, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x")).where(F.contains("x", F.lit("|")))
    cells = lines.select("doc_id", F.col("line").cast("long").alias("line"), F.posexplode(F.split("x", "\\|")).alias("col", "cell"))
    return cells.select("doc_id", "line", F.col("col").cast("long").alias("col"), F.trim("cell").alias("cell")).where("cell <> ''")


@query(f"""with {CEN}, s as (select a.vec_id, a.label as own, cv.label, round(list_dot_product(embedding::double[], centroid), 6) as s from embeddings a, cv), b as (select *, row_number() over (partition by vec_id order by s desc, label) as k from s),
o as (select vec_id, s as own_s from s where own = label)
select b.vec_id, b.own as from_label, b.label as to_label, round(b.s - own_s, 6) as gain from b join o on b.vec_id = o.vec_id where k = 1 and b.own <> b.label""")
def c04_x28_move_suggestions(spark, d):
    v = load(spark, d, "embeddings")
    s = v.select("vec_id", F.col("label").alias("own"), "embedding").crossJoin(vector.centroid_vectors(v, "label")).select("vec_id", "own", "label", F.round(vector.dot(F.col("embedding"), F.col("centroid")), 6).alias("s"))
    best = s.groupBy("vec_id", "own").agg(F.max(F.struct(F.col("s"), (-F.col("label")).alias("l"))).alias("b"), F.max(F.when(F.col("own") == F.col("label"), F.col("s"))).alias("own_s"))
    got = best.select("vec_id", F.col("own").alias("from_label"), (-F.col("b")["l"]).cast("int").alias("to_label"), F.round(F.col("b")["s"] - F.col("own_s"), 6).alias("gain"))
    return got.where("from_label <> to_label")


@query("""select conv_id, turn, length(text) as chars, case when recency <= 4 then 'verbatim' else 'summary' end as kept from (select *, row_number() over (partition by conv_id order by turn desc) as recency from conversations)""")
def t06_transcript_window(spark, d):
    r = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return load(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.when(r <= 4, "verbatim").otherwise("summary").alias("kept"))


@query("""with r as (select user_id, event_type, event_id, sha256(props) as h, row_number() over (partition by user_id, event_type order by ts, event_id) as k, first_value(sha256(props)) over (partition by user_id, event_type order by ts, event_id) as f from events)
select event_id, case when k = 1 then 'proceed' when h = f then 'replay' else 'conflict' end as outcome from r""")
def t09_idempotent_writes(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    h = F.sha2(F.col("props").cast("binary"), 256)
    rows = load(spark, d, "events").select("event_id", "user_id", "event_type", "ts", h.alias("h"))
    return rows.select("event_id", F.when(F.row_number().over(w) == 1, "proceed").when(F.col("h") == F.first("h").over(w), "replay").otherwise("conflict").alias("outcome"))


@query("""with e as (select user_id, event_type, count(*) as n, max(ts) as last from events group by all) select user_id, event_type, n, strftime(last, '%Y-%m-%d') as last from (select *, row_number() over (order by last desc, user_id, event_type) as r from e) where r <= 300""")
def m24_cache_prune(spark, d):
    e = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return e.orderBy(F.desc("last"), "user_id", "event_type").limit(300).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


@query(f"""with m as (select conv_id, turn, text, len(list_intersect(list_distinct({KEY}), ['that', 'the', 'thing', 'ther'])) as overlap, role from conversations)
select conv_id, turn, overlap, rank from (select conv_id, turn, overlap, row_number() over (partition by conv_id order by overlap desc, role, turn desc) as rank from m) where rank <= 3""")
def m16_memory_select(spark, d):
    n = F.size(F.array_intersect(T.keyword_tokens(F.col("text")), F.array(*map(F.lit, ("that", "the", "thing", "ther")))))
    rows = load(spark, d, "conversations").select("conv_id", "turn", "role", n.cast("long").alias("overlap"))
    return relational.top_per_key(rows, ["conv_id"], [F.desc("overlap"), F.col("role"), F.desc("turn")], 3).select("conv_id", "turn", "overlap", "rank")


@query(f"""with c as (select doc_id, source, {TOK} as t, text from documents), s as (select doc_id, source, len(list_filter(t, lambda x: x in ('the', 'and', 'that', 'tion'))) / greatest(len(t), 1) as score from c)
select source, arg_max(doc_id, (round(score, 6), -doc_id)) as doc_id, round(max(score), 6) as score, case when max(score) >= 0.12 then 'analyzed' else 'low_relevance' end as status from s group by source""")
def m21_analysis_packets(spark, d):
    t = T.tokens(F.col("text"))
    score = F.round(F.size(F.filter(t, lambda x: x.isin("the", "and", "that", "tion"))) / F.greatest(F.size(t), F.lit(1)), 6)
    rows = load(spark, d, "documents").select("doc_id", "source", score.alias("score"))
    got = rows.groupBy("source").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))
    return got.withColumn("status", F.when(F.col("score") >= 0.12, "analyzed").otherwise("low_relevance"))


@query("""with n as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as p from pages)
select p[1] as root, count(*) as nodes, count(distinct array_to_string(p, '/')) as files from n group by 1""")
def g36_community_rollup(spark, d):
    p = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/"), lambda x: x != "")
    return load(spark, d, "pages").select(p.alias("p")).select(F.col("p")[0].alias("root"), F.array_join("p", "/").alias("f")).groupBy("root").agg(F.count("*").alias("nodes"), F.count_distinct("f").alias("files"))


@query("""with recursive e as (select distinct l_suppkey as a, l_partkey + 1000000 as b from lineitem where l_quantity > 49), p as (select l_orderkey as a, l_suppkey as b from lineitem where l_quantity > 49),
w as (select a as node, b as seen, 1 as d from e union select w.node, e2.b, 2 from w join p on w.seen - 1000000 = p.a join e e2 on p.b = e2.a where d < 2)
select node, count(distinct seen) as reached from w group by node""")
def r13_blast_radius(spark, d):
    li = load(spark, d, "lineitem").where("l_quantity > 49")
    e = li.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b")).distinct()
    p = li.select(F.col("l_orderkey").alias("x"), F.col("l_suppkey").alias("y")).distinct()
    one = e.select(F.col("a").alias("node"), F.col("b").alias("seen"))
    two = one.join(p, F.col("seen") - 1000000 == F.col("x")).select("node", "y").distinct().join(e.select(F.col("a").alias("y"), F.col("b").alias("far")), "y").select("node", F.col("far").alias("seen"))
    return one.unionByName(two).groupBy("node").agg(F.count_distinct("seen").alias("reached"))
