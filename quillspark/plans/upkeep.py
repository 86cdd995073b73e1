"""Queries over sections, sessions, run logs and folders: what keeps a collection named, fresh and within bounds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import text as T
from ..operators import relational
from ..sources.formats import markdown_sections
from ..sources.tables import load
from .evidence import SENT
from .registry import query
from .text import KEY

CHUNK_LINES = 80
#: Bounds of a delta sync, of a run log and of an extraction window.
MOST_CHANGED, FEW_ITEMS, LEAST_SHARE = 500, 100, 25
LOG_DAYS, LOG_ITEMS = 30, 2000
WINDOW_CHARS = 500
BARE_URL = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query("select doc_id, source is null as unscoped from documents where lang = 'en' and n_chars >= 200 and (source = 'src1' or source is null)")
def f01_f02_eligibility(spark, d):
    scope = (F.col("source") == "src1") | F.col("source").isNull()
    return load(spark, d, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 200) & scope).select("doc_id", F.col("source").isNull().alias("unscoped"))


@query(f"select doc_id, left(array_to_string({SENT}[1:2], ' '), 360) as summary from documents")
def f10_summary(spark, d):
    return load(spark, d, "documents").select("doc_id", F.substring(F.array_join(F.slice(T.sentences(F.col("text")), 1, 2), " "), 1, 360).alias("summary"))


@query(f"""with p as (select page_id, list_filter(string_split({BARE_URL}, '/'), lambda x: x <> '') as p from pages)
select page_id, p[-1] as base, cast(len(p) as bigint) as depth, array_to_string(p[1:len(p) - 1], '/') as parent,
  case when regexp_matches(p[-1], '\\.(md|txt|html?)$') then 'document' when regexp_matches(p[-1], '\\.(json|ya?ml|toml)$') then 'config' when regexp_matches(p[-1], '(^test|_test\\.|\\.spec\\.)') then 'test' else 'other' end as role from p""")
def f15_x33_paths(spark, d):
    p = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/"), lambda x: x != "")
    base = F.element_at("p", -1)
    role = F.when(base.rlike(r"\.(md|txt|html?)$"), "document").when(base.rlike(r"\.(json|ya?ml|toml)$"), "config").when(base.rlike(r"(^test|_test\.|\.spec\.)"), "test").otherwise("other")
    return load(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", base.alias("base"), F.size("p").cast("long").alias("depth"), F.array_join(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), "/").alias("parent"), role.alias("role"))


@query("select conv_id, role, turn, rank from (select conv_id, role, turn, row_number() over (partition by conv_id, role order by turn desc) as rank from conversations) where rank <= 2")
def w07_latest_per_topic(spark, d):
    return relational.top_per_key(load(spark, d, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], [F.desc("turn")], 2)


@query("select o_custkey as id from orders union select user_id from events")
def u03_union_distinct(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("id")).union(load(spark, d, "events").select("user_id")).distinct()


@query("""with l as (select l_suppkey, l_partkey, bool_or(l_returnflag = 'N') as hit from lineitem group by all)
select l_suppkey, count(*) filter (hit) as covered, count(*) filter (not hit) as missed, round(count(*) filter (hit) / count(*), 6) as share from l group by l_suppkey""")
def g18_coverage_union(spark, d):
    hit = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("hit"))
    return hit.groupBy("l_suppkey").agg(F.count_if("hit").alias("covered"), F.count_if(~F.col("hit")).alias("missed"), F.round(F.count_if("hit") / F.count("*"), 6).alias("share"))


@query(f"""with e as (select source, unnest(list_distinct({KEY})) as term from documents), c as (select source, term, count(*) as df from e group by all),
r as (select *, row_number() over (partition by source order by df desc, term) as rank from c)
select source, string_agg(term, ' ' order by rank) filter (rank <= 2) as name, string_agg(term, ', ' order by rank) as description from r where rank <= 3 group by source""")
def c03_cluster_names(spark, d):
    each = load(spark, d, "documents").select("source", F.explode(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("term"))
    top = relational.top_per_key(each.groupBy("source", "term").agg(F.count("*").alias("df")), ["source"], [F.desc("df"), F.col("term")], 3)
    named = top.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t")).select("source", F.col("t.term").alias("t"))
    return named.select("source", F.array_join(F.slice("t", 1, 2), " ").alias("name"), F.array_join("t", ", ").alias("description"))


@query(f"""with c as (select conv_id, turn, length(coalesce(text, '')) as n from conversations), r as (select *, sum(n) over (partition by conv_id order by turn rows unbounded preceding) - n as above from c)
select conv_id, cast(floor(above / {WINDOW_CHARS}) as bigint) as part, count(*) as turns, cast(sum(n) as bigint) as chars from r group by all""")
def m09_session_windows(spark, d):
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    above = F.sum("n").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("part", F.floor(above / WINDOW_CHARS)).groupBy("conv_id", "part").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"))


@query(f"""with m as (select max(o_orderdate) as now from orders),
r as (select o_orderkey, o_orderdate, now, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rank from orders, m)
select o_orderkey, case when o_orderdate < now - interval {LOG_DAYS} day then 'old' when rank > {LOG_ITEMS} then 'beyond' else 'kept' end as fate from r""")
def t11_run_log_prune(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).crossJoin(F.broadcast(now))
    old = F.col("o_orderdate") < F.col("now") - F.expr(f"interval {LOG_DAYS} days")
    return ranked.select("o_orderkey", F.when(old, "old").when(F.col("rank") > LOG_ITEMS, "beyond").otherwise("kept").alias("fate"))


@query(f"""with u as (select user_id, count(*) as n, count(*) filter (event_type = 'error') as changed from events group by user_id)
select user_id, n, changed, case when changed = 0 then 'fresh' when changed <= {MOST_CHANGED} and (n < {FEW_ITEMS} or changed <= greatest({LEAST_SHARE}, n // 5)) then 'delta' else 'full' end as sync from u""")
def t10_freshness(spark, d):
    u = load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("changed"))
    small = (F.col("changed") <= MOST_CHANGED) & ((F.col("n") < FEW_ITEMS) | (F.col("changed") <= F.greatest(F.lit(LEAST_SHARE), F.floor(F.col("n") / 5))))
    return u.withColumn("sync", F.when(F.col("changed") == 0, "fresh").when(small, "delta").otherwise("full"))


@query("""with c as (select *, length(coalesce(text, '')) // 4 as t, row_number() over (partition by conv_id order by turn desc) as recency from conversations),
s as (select conv_id, sum(t) as raw, sum(t) filter (recency <= 4) as recent, coalesce(sum(t) filter (role = 'assistant'), 0) as answers from c group by conv_id),
u as (select 'raw' as strategy, raw, raw as tokens from s union all select 'recent', raw, recent from s union all select 'answers', raw, answers from s)
select strategy, round(avg(tokens), 4) as mean_tokens, round(case when sum(raw) > 0 then 100 * (1 - sum(tokens) / sum(raw)) else 0 end, 4) as reduction from u group by strategy""")
def m23_strategy_comparison(spark, d):
    recency = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    c = load(spark, d, "conversations").select("conv_id", "role", F.floor(F.length(F.coalesce("text", F.lit(""))) / 4).alias("t"), recency.alias("recency"))
    s = c.groupBy("conv_id").agg(F.sum("t").alias("raw"), F.sum(F.when(F.col("recency") <= 4, F.col("t"))).alias("recent"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.col("t"))), F.lit(0)).alias("answers"))
    u = s.selectExpr("raw", "stack(3, 'raw', raw, 'recent', recent, 'answers', answers) as (strategy, tokens)")
    cut = F.when(F.sum("raw") > 0, 100 * (1 - F.sum("tokens") / F.sum("raw"))).otherwise(0.0)
    return u.groupBy("strategy").agg(F.round(F.avg("tokens"), 4).alias("mean_tokens"), F.round(cut, 4).alias("reduction"))


@query(f"""with k as (select conv_id, turn, role, list_distinct({KEY}) as k from conversations), q as (select conv_id, arg_min(k, turn) as q from k where role = 'user' group by conv_id),
s as (select conv_id, turn, 2 * len(list_intersect(k, q)) + 1.0 / row_number() over (partition by conv_id order by turn) as score from k join q using (conv_id) where role = 'assistant')
select conv_id, turn, round(score, 6) as score from s""")
def x26_fact_score(spark, d):
    k = load(spark, d, "conversations").select("conv_id", "turn", "role", F.array_distinct(T.keyword_tokens(F.col("text"))).alias("k"))
    q = k.where("role = 'user'").groupBy("conv_id").agg(F.min_by("k", "turn").alias("q"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return k.where("role = 'assistant'").join(q, "conv_id").select("conv_id", "turn", F.round(2 * F.size(F.array_intersect("k", "q")) + 1.0 / rank, 6).alias("score"))


@query(f"""with l as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null), c as (select doc_id, l, unnest(range(0, (len(l) + {CHUNK_LINES - 1}) // {CHUNK_LINES})) as part from l)
select doc_id, part, cast(len(l[part * {CHUNK_LINES} + 1:(part + 1) * {CHUNK_LINES}]) as bigint) as n_lines, sha256(array_to_string(l[part * {CHUNK_LINES} + 1:(part + 1) * {CHUNK_LINES}], chr(10))) as part_sha256 from c""")
def x11_line_chunks(spark, d):
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", T.line_chunks(F.col("text"), CHUNK_LINES).alias("c"))
    return rows.select("doc_id", F.posexplode("c").alias("i", "c")).select("doc_id", F.col("i").cast("long").alias("part"), F.size(F.split("c", "\n")).cast("long").alias("n_lines"), F.sha2(F.col("c").cast("binary"), 256).alias("part_sha256"))


@query("""with s as (select doc_id, list_filter(string_split(regexp_replace(text, '(?m)^(#{1,6}\\s)', chr(9246) || '\\1', 'g'), chr(9246)), lambda x: length(trim(x, ' ')) > 0) as s from documents where text is not null)
select doc_id, cast(len(s) as bigint) as n_sections, sha256(array_to_string(list_transform(s, lambda x: cast(length(x) as varchar)), ',')) as lengths_sha256 from s""")
def x08_markdown_sections(spark, d):
    rows = load(spark, d, "documents").where("text is not null").select("doc_id", markdown_sections(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sections"), F.sha2(F.array_join(F.transform("s", lambda x: F.length(x).cast("string")), ",").cast("binary"), 256).alias("lengths_sha256"))


@query("select conv_id, turn, " + ", ".join("case " + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{p}') then '{k}'" for k, p in kinds) + f" else '{other}' end as {name}" for name, kinds, other in C.LABELS) + " from conversations")
def x24_ledger_labels(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", *(C.first_label(F.col("text"), kinds, other).alias(name) for name, kinds, other in C.LABELS))
