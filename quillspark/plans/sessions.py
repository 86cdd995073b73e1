"""Queries over scans, chats, facts and packets: reconciling, routing, citing, correcting, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import claims as C
from ..functions import text as T
from ..operators import graph, lexical, relational, vector
from ..sources.tables import load
from .evidence import SENT
from .registry import query
from .retrieval import BM25, VEC, _vectors
from .upkeep import BARE_URL

#: Tokens a prompt may take (base, least, most) and what length, doubt and questions do to them.
BUDGET, LEAST_BUDGET, MOST_BUDGET = 2000, 512, 8000
LONG_PROMPT, QUESTION_BONUS = 400, 400
#: Citations by budget (at least, citations), first match wins.
TIERS = ((2000, 10), (1000, 7), (500, 5), (0, 3))
NEWEST, LEAST_CONFIDENCE, SURE_CHARS = 5, 0.75, 200


@query("""with b as (select l_orderkey as path, min(l_partkey) as mark from lineitem where l_linenumber = 3 group by all), a as (select l_orderkey as path, min(l_partkey) as mark from lineitem where l_linenumber = 1 and l_linestatus = 'O' group by all),
gone as (select * from b anti join a using (path)), fresh as (select * from a anti join b using (path)),
moved as (select f.path, g.was from (select mark, min(path) as path from fresh group by mark having count(*) = 1) f join (select mark, min(path) as was from gone group by mark having count(*) = 1) g using (mark))
select path, cast(null as bigint) as was, case when a.mark = b.mark then 'unchanged' else 'updated' end as action from a join b using (path)
union all select fresh.path, was, case when was is null then 'imported' else 'moved' end from fresh left join moved on fresh.path = moved.path
union all select gone.path, null, 'tombstoned' from gone left join moved on gone.path = moved.was where moved.was is null""")
def s15_s16_reconcile(spark, d):
    li = load(spark, d, "lineitem")
    scan = lambda rows: rows.groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_partkey").alias("mark"))
    return relational.reconcile(scan(li.where("l_linenumber = 3")), scan(li.where("l_linenumber = 1 and l_linestatus = 'O'")), "path", "mark")


@query("""select conv_id, turn, role, row_number() over w - 1 as turn_index, lag(role) over w as after_role, sha256(coalesce(text, '')) as text_sha256 from conversations window w as (partition by conv_id order by turn)""")
def s23_chat_payload(spark, d):
    w = relational.ordered(["conv_id"], ["turn"])
    return load(spark, d, "conversations").select(
        "conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("turn_index"), F.lag("role").over(w).alias("after_role"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


@query("""select event_id, case event_type when 'purchase' then strftime(cast(ts as date) - 1, '%Y-%m-%d') when 'click' then strftime(last_day(cast(ts as date) - interval 1 month), '%Y-%m-%d') when 'view' then strftime(ts, '%Y-%m-%d') end || 'T23:59:59Z' as as_of from events""")
def x23_as_of(spark, d):
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    phrase = F.when(F.col("event_type") == "purchase", "yesterday").when(F.col("event_type") == "click", "last month").when(F.col("event_type") == "view", F.date_format("day", "yyyy-MM-dd")).otherwise("2024-02-30")
    return e.select("event_id", F.concat(F.date_format(C.as_of_day(F.concat(F.lit("The total as of "), phrase), F.col("day")), "yyyy-MM-dd"), F.lit("T23:59:59Z")).alias("as_of"))


@query(f"""select conv_id, turn, cast(least({MOST_BUDGET}, greatest({LEAST_BUDGET}, case when length(coalesce(text, '')) > {LONG_PROMPT} then {BUDGET} * 3 // 2 else {BUDGET} end
  + case when contains(coalesce(text, ''), '?') then {QUESTION_BONUS} else 0 end - case when {" or ".join(f"contains(regexp_replace(lower(coalesce(text, '')), '[[:space:]]+', ' ', 'g'), '{p}')" for p in C.STEERING)} then {BUDGET} // 2 else 0 end)) as bigint) as budget from conversations where role = 'user'""")
def x29_context_budget(spark, d):
    text = F.coalesce("text", F.lit(""))
    size = F.when(F.length(text) > LONG_PROMPT, BUDGET * 3 // 2).otherwise(BUDGET) + F.when(text.contains("?"), QUESTION_BONUS).otherwise(0) - F.when(C.steering(text), BUDGET // 2).otherwise(0)
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.least(F.lit(MOST_BUDGET), F.greatest(F.lit(LEAST_BUDGET), size)).cast("long").alias("budget"))


@query(r"""with n as (select p_partkey, lower(p_brand || ' ' || p_name || ' ' || p_size || '.5 ' || p_size || 'b-Instruct') as n from part),
f as (select p_partkey, n, trim(regexp_replace(regexp_replace(regexp_replace(n, '[-_ ](instruct|chat|base|it)$', ''), '([0-9]+)\.[0-9]+', '\1', 'g'), '[^a-z0-9]+', '-', 'g'), '-') as name from n)
select p_partkey, name, string_split(name, '-')[1] as family, cast(regexp_extract(n, '([0-9]+)b\b', 1) as double) as billions from f""")
def x37_family_names(spark, d):
    n = F.concat("p_brand", F.lit(" "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 "), F.col("p_size").cast("string"), F.lit("b-Instruct"))
    return load(spark, d, "part").select("p_partkey", T.family_name(n).alias("name"), T.billions(n).alias("billions")).select("p_partkey", "name", F.element_at(F.split("name", "-"), 1).alias("family"), "billions")


@query(f"""with s as (select conv_id, turn, {SENT}[1] as excerpt from conversations), f as (select conv_id, arg_min(coalesce(text, ''), turn) as content from conversations group by conv_id)
select conv_id, turn, cast(strpos(content, excerpt) - 1 as bigint) as char_offset, strpos(content, excerpt) > 0 as verbatim from s join f using (conv_id) where excerpt is not null""")
def x39_citation_offsets(spark, d):
    c = load(spark, d, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by(F.coalesce("text", F.lit("")), "turn").alias("content"))
    cited = c.select("conv_id", "turn", F.get(T.sentences(F.col("text")), 0).alias("excerpt")).where("excerpt is not null").join(first, "conv_id")
    at = F.expr("instr(content, excerpt)")
    return cited.select("conv_id", "turn", (at - 1).cast("long").alias("char_offset"), (at > 0).alias("verbatim"))


@query(f"""with p as (select list_filter(string_split({BARE_URL}, '/'), lambda x: x <> '') as p from pages), e as (select p, unnest(range(2, len(p) + 1)) as k from p)
select array_to_string(p[1:k - 1], '/') as parent, array_to_string(p[1:k], '/') as child, k - 1 as depth, count(*) as pages from e group by all""")
def r05_tree_projection(spark, d):
    p = F.filter(F.split(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/"), lambda x: x != "")
    e = load(spark, d, "pages").select(p.alias("p")).where("size(p) >= 2").select("p", F.explode(F.sequence(F.lit(2), F.size("p"))).alias("k"))
    upto = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    return e.groupBy(upto(F.col("k") - 1).alias("parent"), upto(F.col("k")).alias("child"), (F.col("k") - 1).cast("long").alias("depth")).agg(F.count("*").alias("pages"))


@query("""with e as (select distinct o_custkey as c, l_suppkey as s from orders join lineitem on o_orderkey = l_orderkey),
g as (select 'customer' as kind, c as node, count(*) as degree from e group by all union all select 'supplier', s, count(*) from e group by all),
h as (select kind, count(*) as nodes from g group by kind), r as (select *, row_number() over (partition by kind order by degree desc, node) as rank from g)
select kind, nodes, node, degree, rank from r join h using (kind) where rank <= 10""")
def r15_graph_insights(spark, d):
    base = 10**12  # suppliers are numbered above customers
    e = load(spark, d, "orders").join(load(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + base).alias("dst"))
    g = graph.degrees(e).select(F.when(F.col("node") >= base, "supplier").otherwise("customer").alias("kind"), F.pmod("node", F.lit(base)).alias("node"), (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    sizes = g.groupBy("kind").agg(F.count("*").alias("nodes"))  # two rows
    return relational.top_per_key(g, ["kind"], [F.desc("degree"), F.col("node")], 10).join(F.broadcast(sizes), "kind").select("kind", "nodes", "node", "degree", "rank")


@query("""select source, count(*) as n, max(doc_id) as newest, bit_xor(cast('0x' || substr(sha256(doc_id || '|' || sha256(coalesce(text, ''))), 1, 15) as bigint)) as members from documents group by source""")
def c05_profile_hash(spark, d):
    mark = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).cast("binary"), 256)
    return load(spark, d, "documents").select("source", "doc_id", F.conv(F.substring(mark, 1, 15), 16, 10).cast("long").alias("m")).groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"), F.bit_xor("m").alias("members"))


@query(f"""with r as (select source, doc_id, row_number() over (partition by source order by doc_id desc) as rank, count(*) over (partition by source) as total from documents)
select source, doc_id, rank, total, total > {NEWEST} as truncated from r where rank <= {NEWEST}""")
def c08_neighborhood(spark, d):
    docs = load(spark, d, "documents").select("source", "doc_id")
    total = docs.groupBy("source").agg(F.count("*").alias("total"))
    near = relational.top_per_key(docs, ["source"], [F.desc("doc_id")], NEWEST).alias("n")
    return near.join(total.alias("t"), F.col("n.source").eqNullSafe(F.col("t.source"))).select("n.source", "doc_id", "rank", "total", (F.col("total") > NEWEST).alias("truncated"))


@query(f"""with s as (select conv_id, turn, coalesce(role, '') as role, {SENT} as s from conversations), e as (select conv_id, turn, role, unnest(s) as t, unnest(range(len(s))) as pos from s),
k as (select conv_id, role, array_to_string(string_split(lower(t), ' ')[1:2], ' ') as topic, sha256(conv_id || '|' || role || '|' || lower(t)) as fingerprint, min({{'t': turn, 'p': pos}}) as spot from e group by all),
v as (select *, lead(spot) over (partition by conv_id, role, topic order by spot, fingerprint) as nxt from k)
select conv_id, role, spot.t as turn, spot.p as pos, fingerprint, nxt.t as until_turn, case when nxt is null then 'current' else 'superseded' end as status from v""")
def m01_m02_fact_records(spark, d):
    role = F.coalesce("role", F.lit(""))
    e = load(spark, d, "conversations").select("conv_id", "turn", role.alias("role"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "t"))
    low = F.lower("t")
    topic = F.array_join(F.slice(F.split(low, " "), 1, 2), " ")
    fingerprint = F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), "role", low).cast("binary"), 256)
    known = e.groupBy("conv_id", "role", topic.alias("topic"), fingerprint.alias("fingerprint")).agg(F.min(F.struct("turn", F.col("pos").cast("long").alias("pos"))).alias("at"))
    facts = relational.validity(known, ["conv_id", "role", "topic"], "at", ["fingerprint"])
    return facts.select("conv_id", "role", "at.turn", "at.pos", "fingerprint", F.col("valid_until.turn").alias("until_turn"), "status")


@query("""with f as (select o_orderkey as k, o_orderstatus as value, o_orderdate as since from orders union all select l_orderkey, 'returned', max(l_shipdate) from lineitem where l_returnflag = 'R' group by l_orderkey),
v as (select *, lead(since) over (partition by k order by since, value) as until from f)
select k as o_orderkey, value, strftime(since, '%Y-%m-%d') as valid_from, strftime(until, '%Y-%m-%d') as valid_until, case when until is null then 'current' else 'superseded' end as status from v""")
def m05_corrections(spark, d):
    facts = load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("since"))
    fixes = load(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("since")).select("o_orderkey", F.lit("returned").alias("value"), "since")
    now = relational.validity(facts.unionByName(fixes), ["o_orderkey"], "since", ["value"])
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return now.select("o_orderkey", "value", day("since").alias("valid_from"), day("valid_until").alias("valid_until"), "status")


@query("""with o as (select l_orderkey, count(*) as n, count(distinct l_linestatus) as units, count(distinct l_suppkey) as sources, bool_and(l_discount > 0) as typed from lineitem group by l_orderkey)
select l_orderkey, n, concat_ws(',', case when n < 2 then 'operands' end, case when units <> 1 then 'unit' end, case when sources < 2 then 'sources' end, case when not typed then 'types' end) as missing from o""")
def m10_contract(spark, d):
    o = load(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_distinct("l_linestatus").alias("units"), F.count_distinct("l_suppkey").alias("sources"), F.bool_and(F.col("l_discount") > 0).alias("typed")
    )
    lacks = {"operands": F.col("n") < 2, "unit": F.col("units") != 1, "sources": F.col("sources") < 2, "types": ~F.col("typed")}
    return o.select("l_orderkey", "n", F.concat_ws(",", *(F.when(c, k) for k, c in lacks.items())).alias("missing"))


@query(f"""with {BM25}, t as (select item_id, string_agg(rank || '. [' || doc_id || ']', chr(10) order by rank) as listed, max(rank) as cited from ranked where rank <= 3 group by item_id)
select item_id, cast(coalesce(cited, 0) as bigint) as cited, sha256(concat_ws(chr(10), '# Query', coalesce(text, ''), '# Evidence', listed)) as packet_sha256 from benchmark left join t using (item_id)""")
def m19_context_packets(spark, d):
    items = load(spark, d, "benchmark")
    top = lexical.bm25(load(spark, d, "documents"), items, k=3).select("item_id", "rank", F.concat(F.col("rank").cast("string"), F.lit(". ["), F.col("doc_id").cast("string"), F.lit("]")).alias("line"))
    listed = top.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l")).select("item_id", F.size("l").alias("cited"), F.array_join(F.col("l.line"), "\n").alias("listed"))
    packet = F.concat_ws("\n", F.lit("# Query"), F.coalesce("text", F.lit("")), F.lit("# Evidence"), "listed")
    return items.join(listed, "item_id", "left").select("item_id", F.coalesce("cited", F.lit(0)).cast("long").alias("cited"), F.sha2(packet.cast("binary"), 256).alias("packet_sha256"))


_TIER = "case " + " ".join(f"when budget >= {b} then {n}" for b, n in TIERS) + " end"


@query(f"""with {BM25}, b as (select item_id, budget, {_TIER} as tier from (select item_id, 4 * length(coalesce(text, '')) as budget from benchmark))
select item_id, doc_id, rank, cast(tier as bigint) as tier, cast(budget // tier as bigint) as share from ranked join b using (item_id) where rank <= tier""")
def k10_k12_citations(spark, d):
    items = load(spark, d, "benchmark")
    b = items.select("item_id", (4 * F.length(F.coalesce("text", F.lit("")))).cast("long").alias("budget")).selectExpr("item_id", "budget", f"cast({_TIER} as bigint) as tier")
    top = lexical.bm25(load(spark, d, "documents"), items, k=TIERS[0][1])
    return top.join(b, "item_id").where("rank <= tier").select("item_id", "doc_id", "rank", "tier", F.floor(F.col("budget") / F.col("tier")).alias("share"))


@query(f"""with r as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), chr(10)) as l from documents),
k as (select doc_id, l, list_filter(l, lambda x: trim(x, ' ') <> '' and not regexp_matches(lower(x), '{T.BOILERPLATE}')) as k from r)
select doc_id, cast(len(l) as bigint) as n_lines, cast(len(l) - len(k) as bigint) as n_dropped, sha256(array_to_string(k, chr(10))) as clean_sha256 from k""")
def f09_cleaned_text(spark, d):
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]+>", " "), "\n")
    rows = load(spark, d, "documents").select("doc_id", lines.alias("l")).withColumn("k", T.content_lines(F.col("l")))
    return rows.select("doc_id", F.size("l").cast("long").alias("n_lines"), (F.size("l") - F.size("k")).cast("long").alias("n_dropped"), F.sha2(F.array_join("k", "\n").cast("binary"), 256).alias("clean_sha256"))


def _labelled(kinds, other):
    return "case " + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{p}') then '{k}'" for k, p in kinds) + f" else '{other}' end"


@query(f"select conv_id, turn, {_labelled(C.HARMS, 'none')} as category, regexp_matches(lower(coalesce(text, '')), '{C.PROCEDURE}') and {_labelled(C.HARMS, 'none')} <> 'none' as blocked from conversations where role = 'user'")
def f13_harm_gate(spark, d):
    kind = C.first_label(F.col("text"), C.HARMS, "none")
    return load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", kind.alias("category"), (F.lower(F.coalesce("text", F.lit(""))).rlike(C.PROCEDURE) & (kind != "none")).alias("blocked"))


@query(f"select conv_id, turn, {_labelled(C.ROUTES, 'general')} as route, case when {_labelled(C.ROUTES, 'general')} in ('greeting', 'general') then 'direct' else 'grounded' end as mode from conversations where role = 'user'")
def f16_question_route(spark, d):
    rows = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", C.first_label(F.col("text"), C.ROUTES, "general").alias("route"))
    return rows.withColumn("mode", F.when(F.col("route").isin("greeting", "general"), "direct").otherwise("grounded"))


@query(f"""with c as (select conv_id, turn, role, {_labelled(C.LABELS[0][1], C.LABELS[0][2])} as mode, least(1.0, length(coalesce(text, '')) / {SURE_CHARS}.0) as confidence from conversations)
select conv_id, turn, mode, round(cast(confidence as double), 4) as confidence from c where role in ('user', 'assistant') and mode in ('asserted', 'plan') and confidence >= {LEAST_CONFIDENCE}""")
def f19_eligible_claims(spark, d):
    rows = load(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    rows = rows.select("conv_id", "turn", C.first_label(F.col("text"), C.LABELS[0][1], C.LABELS[0][2]).alias("mode"), F.least(F.lit(1.0), F.length(F.coalesce("text", F.lit(""))) / SURE_CHARS).alias("confidence"))
    return rows.where(F.col("mode").isin("asserted", "plan") & (F.col("confidence") >= LEAST_CONFIDENCE)).withColumn("confidence", F.round("confidence", 4))


@query(f"with {VEC} select query_id, id, score, rank from r where rank <= 5")
def k03_x05_quantized_topk(spark, d):
    v = _vectors(spark, d)
    return vector.quantized_top_k(v.where("id % 20 = 0"), v, k=5)
