"""Queries over a project: names and where they are defined, hits, changes, decisions, shared evidence, structured claims, streamed scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import decisions as D
from ..functions import statements as S
from ..functions import text as T
from ..operators import claims as P
from ..operators import packing, relational
from ..session import shared_folder
from ..sources.tables import load
from ..streaming import windows
from .packs import BUDGET, SCORED, _claims
from .registry import query

#: Parts are symbols of the file of their brand; a file imports another; lines of an order refer to each other's parts.
SYMBOLS = "select distinct p_brand as file, p_name || '_' || p_size as name from part"
IMPORTS = "select distinct p_brand as file, 'Brand#' || ((cast(substring(p_brand, 7) as int) * 3) % 25 + 1) as used from part"
REFERENCES = """select distinct file, name from (select lag(p_brand) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as file, p_name || '_' || p_size as name
  from lineitem join part on l_partkey = p_partkey) where file is not null"""


@query(f"""with s as ({SYMBOLS}), i as ({IMPORTS}), r as ({REFERENCES}), n as (select name, count(*) as n, min(file) as any_file from s group by name),
m as (select r.file, r.name, count(*) as found, min(s.file) as target from r join i on i.file = r.file join s on s.file = i.used and s.name = r.name group by all),
a as (select r.file, r.name, coalesce(m.found, 0) as found, m.target as imported, coalesce(n.n, 0) as n, n.any_file, n.any_file = r.file or n.any_file in (select used from i where i.file = r.file) as near
  from r left join m on m.file = r.file and m.name = r.name left join n on n.name = r.name)
select file, name, case when found = 1 then 'import' when n = 1 and near then 'unique' when n = 1 then 'suggested' when n > 1 then 'ambiguous' else 'unknown' end as how,
  case when found = 1 then imported when n = 1 then any_file end as target, case when found = 1 or n = 1 and near then 1.0::double when n = 1 then 0.65::double when n > 1 then 0.45::double end as confidence from a""")
def j15_name_resolution(spark, d):
    """Where the parts that a brand's orders go on to are defined: in an imported file, or the only one of their name, or a suggestion."""
    for t in ("part", "lineitem"):
        load(spark, d, t).createOrReplaceTempView(f"__ql_{t}")
    s, i, r = (spark.sql(q.replace("from part", "from __ql_part").replace("from lineitem join part", "from __ql_lineitem join __ql_part")) for q in (SYMBOLS, IMPORTS, REFERENCES))
    known = s.groupBy("name").agg(F.count("*").alias("n"), F.min("file").alias("any_file"))
    through = r.join(i, "file").join(s.withColumnRenamed("file", "used"), ["used", "name"]).groupBy("file", "name").agg(F.count("*").alias("found"), F.min("used").alias("imported"))
    a = r.join(through, ["file", "name"], "left").join(known, "name", "left")
    a = a.join(i.select("file", F.col("used").alias("any_file"), F.lit(True).alias("near")), ["file", "any_file"], "left")
    near = F.coalesce("near", F.lit(False)) | F.coalesce(F.col("any_file") == F.col("file"), F.lit(False))
    how = F.when(F.col("found") == 1, "import").when((F.col("n") == 1) & near, "unique").when(F.col("n") == 1, "suggested").when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    a = a.withColumn("how", how)
    target = F.when(F.col("how") == "import", F.col("imported")).when(F.col("n") == 1, F.col("any_file"))
    sure = F.when(F.col("how").isin("import", "unique"), 1.0).when(F.col("how") == "suggested", 0.65).when(F.col("how") == "ambiguous", 0.45)
    return a.select("file", "name", "how", target.alias("target"), sure.alias("confidence"))


WORDS, HITS = ("steel", "ring", "blue"), 12


@query(f"""with h as (select p_partkey, p_name, min(case when p_name = w then 0 when starts_with(p_name, w) then 1 when contains(p_name, w) then 2 end) as score from part, (select unnest({list(WORDS)}) as w) group by all)
select p_partkey, p_name, score, row_number() over (order by score, p_name, p_partkey) as place from h where score is not null qualify place <= {HITS}""")
def r16_structural_hits(spark, d):
    """The twelve parts whose names fit one of the words best."""
    one = [F.when(F.col("p_name") == w, 0).when(F.startswith("p_name", F.lit(w)), 1).when(F.contains("p_name", F.lit(w)), 2) for w in WORDS]
    top = load(spark, d, "part").select("p_partkey", "p_name", F.least(*one).alias("score")).where("score is not null").orderBy("score", "p_name", "p_partkey").limit(HITS)
    return top.withColumn("place", F.row_number().over(Window.orderBy("score", "p_name", "p_partkey")).cast("long"))


CHANGED_SINCE, DEPENDENTS, PARTNERS = "1998-06-01", 30, 20
#: Pairs of parts that a task counts.
PAIRS = 2_000_000


@query(f"""with c as (select distinct l_partkey as part from lineitem where l_shipdate >= timestamp '{CHANGED_SINCE}'),
e as (select l_partkey as part, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as other from lineitem),
f as (select 'dependent' as kind, other as part, part as other, count(*) as n from e where part <> other group by all
  union all select 'cochange', x.l_partkey, y.l_partkey, count(*) from (select distinct l_orderkey, l_partkey from lineitem) x join (select distinct l_orderkey, l_partkey from lineitem) y on x.l_orderkey = y.l_orderkey and x.l_partkey <> y.l_partkey group by all),
r as (select kind, part, other, n, row_number() over (partition by kind, part order by n desc, other) as rank from f join c using (part))
select kind, part, other, n, rank from r where rank <= case kind when 'dependent' then {DEPENDENTS} else {PARTNERS} end""")
def r17_change_context(spark, d):
    """For each part of a recent line: the parts that come before it in orders, and those most often in one order with it."""
    li = load(spark, d, "lineitem")
    changed = li.where(F.col("l_shipdate") >= F.expr(f"timestamp_ntz '{CHANGED_SINCE} 00:00:00'")).select(F.col("l_partkey").alias("part")).distinct()
    w = relational.ordered(["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")])
    e = li.select(F.lead("l_partkey").over(w).alias("part"), F.col("l_partkey").alias("other")).where("part <> other").join(changed, "part")
    held = li.select("l_orderkey", "l_partkey").distinct()
    both = held.withColumnRenamed("l_partkey", "part").join(changed, "part").join(held.withColumnRenamed("l_partkey", "other"), "l_orderkey").where("part <> other")
    pairs = li.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // PAIRS))  # tasks that count pairs grow with them
    use = e.repartition(parts, "part", "other").groupBy("part", "other").agg(F.count("*").alias("n")).select(F.lit("dependent").alias("kind"), "part", "other", "n")
    together = both.select("part", "other").repartition(parts, "part", "other").groupBy("part", "other").agg(F.count("*").alias("n")).select(F.lit("cochange").alias("kind"), "part", "other", "n")
    ranked = relational.top_per_key(use.unionByName(together).repartition(parts, "kind", "part"), ["kind", "part"], [F.desc("n"), F.col("other")], max(DEPENDENTS, PARTNERS))
    return ranked.where(F.col("rank") <= F.when(F.col("kind") == "dependent", DEPENDENTS).otherwise(PARTNERS)).select("kind", "part", "other", "n", "rank")


NOTE = """case when o_orderkey % 3 = 0 then '# Order ' || o_orderkey || chr(10) else '' end || 'Seen by the desk' || chr(10) || case o_orderstatus when 'F' then 'DECISION: ship as ' || lower(o_orderpriority) || chr(10) || 'why: it is paid' || chr(10) || 'Trade-offs: slow'
  when 'O' then '## RATIONALE: not paid' || chr(10) || 'paths: src/' || o_custkey || '.py; `docs/a.md`,' else 'No more' end"""


@query(f"""with t as (select o_orderkey, o_orderstatus as s, o_orderkey % 3 = 0 as titled, o_custkey, o_orderpriority as p from orders where o_orderstatus <> 'P')
select o_orderkey, case when s = 'F' then 'ship as ' || lower(p) when titled then 'Order ' || o_orderkey else 'Documented architecture decision' end as statement,
  case s when 'F' then 'it is paid slow' else 'not paid' end as rationale, cast(case when titled then 3 else 2 end as bigint) as first_line, cast(case when titled then 3 else 2 end + case s when 'F' then 2 else 0 end as bigint) as last_line,
  case s when 'O' then 'src/' || o_custkey || '.py,docs/a.md' else '' end as paths from t""")
def r18_decisions(spark, d):
    """Decisions in notes on orders: title, statement, rationale, lines, governed paths."""
    notes = load(spark, d, "orders").select("o_orderkey", F.expr(NOTE).alias("text"))
    got = notes.select("o_orderkey", D.decision(F.col("text")).alias("d"), F.array_join(D.governed(F.col("text")), ",").alias("paths")).where("d is not null")
    return got.select("o_orderkey", "d.*", "paths")


ENTITIES, LABELS = 160, 3


@query(f"""with e as (select o_orderdate as day, o_orderpriority as p, o_orderstatus as s, c_nationkey as c from orders join customer on c_custkey = o_custkey group by all),
g as (select day, p, s from e group by all having count(*) > 1 order by day desc, p, s limit {ENTITIES}),
x as (select a.c as a, b.c as b, strftime(day, '%Y-%m-%d') || ' ' || p || ' ' || s as label from e a join e b using (day, p, s) join g using (day, p, s) where a.c < b.c),
r as (select *, row_number() over (partition by a, b order by label desc) as k, count(*) over (partition by a, b) as n from x)
select a, b, n, string_agg(label, '; ' order by label desc) as labels from r where k <= {LABELS} group by a, b, n""")
def c07_evidence_map_edges(spark, d):
    """Nations that share days of orders of one priority and status: the 160 latest such days, up to three named at each pair."""
    entity = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority", "o_orderstatus")
    e = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), entity.alias("label"), F.col("c_nationkey").alias("c")).distinct()
    g = e.groupBy("day", "p", "s", "label").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("day"), "p", "s").limit(ENTITIES).select("label")
    near = e.join(g, "label").select("label", "c")
    x = near.withColumnRenamed("c", "a").join(near.withColumnRenamed("c", "b"), "label").where("a < b")  # 160 labels, nations of each
    r = x.withColumn("k", F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("label")))).withColumn("n", F.count("*").over(Window.partitionBy("a", "b"))).where(f"k <= {LABELS}")
    return r.groupBy("a", "b", "n").agg(F.array_join(F.reverse(F.array_sort(F.collect_list("label"))), "; ").alias("labels"))


SAYING = """case o_orderkey % 6 when 0 then 'I am currently reading ' || lower(o_orderpriority) || ' notes. Fine' when 1 then 'I currently use the ' || o_orderstatus || ' desk!' when 2 then 'now I now have ' || (o_orderkey % 9) || ' items'
  when 3 then 'I keep the ' || o_orderstatus || ' box in the hall.' when 4 then 'I own ' || (o_orderkey % 7) || ' boxes right now.' else 'Nothing to say' end"""


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'currently_reading' when 1 then 'currently_uses' when 3 then 'currently_stored_at' else 'current_quantity' end as predicate,
  case o_orderkey % 6 when 0 then lower(o_orderpriority) || ' notes' when 1 then 'the ' || o_orderstatus || ' desk' when 2 then (o_orderkey % 9) || ' items' when 3 then 'the hall' else (o_orderkey % 7) || ' boxes' end as object,
  case when o_orderkey % 6 in (0, 1, 3) then 0.92::double else 0.9::double end as confidence from orders where o_orderkey % 6 <> 5""")
def x18_structured_claims(spark, d):
    """What customers say of themselves, as predicate and object."""
    rows = load(spark, d, "orders").select("o_orderkey", F.explode(S.stated_claims(F.expr(SAYING), F.lit("user"))).alias("c"))
    return rows.select("o_orderkey", "c.predicate", "c.object", "c.confidence")


QUOTA = 1


@query(f"""with recursive {SCORED},
b as (select *, round(relevance + priority, 6) as score, greatest(1, length(text) // 4, cast(ceil(round(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^ A-Za-z0-9]')) * 1.15, 6)) as bigint)) + {P.FRAME_TOKENS} as cost from m),
f as (select *, row_number() over (partition by question_id, session order by score desc, turn, sentence) <= case when operation = 'aggregate' then 2 else 1 end as quota,
  row_number() over (partition by question_id, mode order by date, session, turn, sentence) as head, row_number() over (partition by question_id, mode order by date desc, session desc, turn desc, sentence desc) as tail from b),
o as (select *, case when quota then 0 when head = 1 or tail = 1 then 1 else 2 end as grp from f),
p as materialized (select *, row_number() over (partition by question_id order by grp, score desc, rank, date desc, turn, session, sentence) as place from o),
t as (select question_id, place, case when cost <= {BUDGET} then cost else 0 end as used, cost <= {BUDGET} as taken from p where place = 1
  union all select p.question_id, p.place, case when used + cost <= {BUDGET} then used + cost else used end, used + cost <= {BUDGET} from t join p on p.question_id = t.question_id and p.place = t.place + 1)
select question_id, session, turn, sentence, grp, place, taken from p join t using (question_id, place)""")
def m11_atomic_pack(spark, d):
    """Facts for each question: a quota of each session, the first and last of each state, then the rest; none may exceed the budget."""
    session, state = Window.partitionBy("question_id", "session"), Window.partitionBy("question_id", "mode")
    c = _claims(spark, d).withColumn("score", F.round(F.col("relevance") + F.col("priority"), 6)).withColumn("cost", T.token_estimate(F.col("text")) + P.FRAME_TOKENS)
    late = [F.desc(x) for x in ("date", "session", "turn", "sentence")]
    c = c.withColumns({"q": F.row_number().over(session.orderBy(F.desc("score"), "turn", "sentence")), "head": F.row_number().over(state.orderBy("date", "session", "turn", "sentence")), "tail": F.row_number().over(state.orderBy(*late))})
    grp = F.when(F.col("q") <= F.when(F.col("operation") == "aggregate", 2).otherwise(QUOTA), 0).when((F.col("head") == 1) | (F.col("tail") == 1), 1).otherwise(2)
    c = c.withColumn("grp", grp).withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("grp", F.desc("score"), "rank", F.desc("date"), "turn", "session", "sentence")).cast("long"))
    return packing.pack(c.select(*P.CLAIM, "grp", "place", "cost"), "question_id", "place", "cost", BUDGET).drop("cost")


@query("select event_type, count(*) as n, cast(sum(user_id) as bigint) as users from events group by event_type")
def t03_incremental_scan(spark, d):
    """Events that arrive in two parts, each read once by a stream that goes on from its checkpoint."""
    mark = spark.range(1).select(F.uuid()).first()[0]
    base = f"{shared_folder(spark).rstrip('/')}/scan-{spark.sparkContext.applicationId}-{mark}"
    events = load(spark, d, "events")
    for part in (0, 1):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(f"{base}/in")
        windows.run_once(windows.events_stream(spark, f"{base}/in", events.schema, 100).drop("at"), f"{base}/out", f"{base}/at")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))
