"""Queries that cut texts by what they are; the texts are rendered from the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks as K
from ..sources.tables import load
from .registry import query

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _listed(rows, key: str, order: list[str], line) -> object:
    """(key, text): the lines of each key's rows in order."""
    each = rows.select(key, F.struct(*order).alias("o"), line.alias("line"))
    return each.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _parts(rows, key: str, cut) -> object:
    """A row a part: (key, part, n_lines, part_sha256)."""
    each = rows.select(key, F.posexplode(cut).alias("part", "x"))
    return each.select(key, F.col("part").cast("long").alias("part"), F.size(F.split("x", "\n")).cast("long").alias("n_lines"), F.sha2(F.col("x").cast("binary"), 256).alias("part_sha256"))


def _parts_sql(key: str) -> str:
    return f"select {key}, cast(part as bigint) as part, len(string_split(x, chr(10))) as n_lines, sha256(x) as part_sha256 from"


def _marked_sql(key: str, mark: str) -> str:
    """Parts of t(key, text) that begin at marked lines."""
    return f"""{_parts_sql(key)} (select {key}, unnest(p) as x, unnest(range(len(p))) as part from
  (select {key}, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^({mark})', chr(1) || '\\1', 'g'), chr(1)),
     lambda x: {STRIP.format('x')}), lambda x: x <> '') as p from t))"""


@query(f"""with t as (select o_custkey, string_agg('diff --git a/' || o_orderkey || ' b/' || o_orderkey || chr(10) || '+' || o_orderstatus || '  ', chr(10) order by o_orderkey) as text
  from orders group by o_custkey) {_marked_sql("o_custkey", "diff --git ")}""")
def x12_diff_chunks(spark, d):
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("diff --git a/"), key, F.lit(" b/"), key, F.lit("\n+"), F.col("o_orderstatus"), F.lit("  "))
    return _parts(_listed(load(spark, d, "orders"), "o_custkey", ["o_orderkey"], line), "o_custkey", K.diff_chunks(F.col("text")))


@query(f"""with t as (select user_id, string_agg(case event_type when 'error' then 'Traceback (most recent call last):' else strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type end
  || chr(10) || '  value ' || cast(floor(value) as bigint), chr(10) order by ts, event_id) as text from events group by user_id)
{_marked_sql("user_id", "[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]|Traceback ")}""")
def x12_log_chunks(spark, d):
    head = F.when(F.col("event_type") == "error", "Traceback (most recent call last):").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("event_type")))
    line = F.concat(head, F.lit("\n  value "), F.floor("value").cast("string"))
    return _parts(_listed(load(spark, d, "events"), "user_id", ["ts", "event_id"], line), "user_id", K.log_chunks(F.col("text")))


@query(f"""with l as (select l_suppkey, l_orderkey || ',' || l_partkey || ',' || cast(l_quantity as bigint) as line, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 as i from lineitem),
p as (select l_suppkey, i // 40 as part, 'order,part,quantity' || chr(10) || string_agg(line, chr(10) order by i) as x from l group by all)
{_parts_sql("l_suppkey")} p""")
def x12_table_chunks(spark, d):
    line = F.concat_ws(",", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("long").cast("string"))
    rows = _listed(load(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], line)
    return _parts(rows, "l_suppkey", K.table_chunks(F.concat(F.lit("order,part,quantity\n\n"), F.col("text"))))


@query(f"""with l as (select l_suppkey, l_linenumber = 1 and l_quantity > 47 as head, row_number() over w as i,
    case when l_linenumber = 1 and l_quantity > 47 then 'order_' || l_orderkey || case when l_returnflag = 'R' then ' {{' else ': x' end else '  quantity ' || cast(l_quantity as bigint) end as line
  from lineitem window w as (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity)),
s as (select *, sum(case when head then 1 else 0 end) over (partition by l_suppkey order by i) as section from l),
k as (select *, (row_number() over (partition by l_suppkey, section order by i) - 1) // 60 as run from s),
p as (select l_suppkey, row_number() over (partition by l_suppkey order by section, run) - 1 as part, string_agg(line, chr(10) order by i) as x from k group by l_suppkey, section, run)
{_parts_sql("l_suppkey")} p""")
def x12_settings_chunks(spark, d):
    head = (F.col("l_linenumber") == 1) & (F.col("l_quantity") > 47)
    named = F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.when(F.col("l_returnflag") == "R", " {").otherwise(": x"))
    line = F.when(head, named).otherwise(F.concat(F.lit("  quantity "), F.col("l_quantity").cast("long").cast("string")))
    return _parts(_listed(load(spark, d, "lineitem"), "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], line), "l_suppkey", K.settings_chunks(F.col("text")))


@query(f"""with recursive turns as (select conv_id, {STRIP.format("role || ': ' || regexp_replace(coalesce(text, ''), chr(10) || '{2,}', chr(10), 'g')")} as x, row_number() over (partition by conv_id order by turn, role) as i from conversations),
t as (select *, len(regexp_extract_all(x, '[^ \\t\\n\\r\\f\\v]+')) as w, count(*) over (partition by conv_id) as n from turns),
s as (select conv_id, i, n, 1 as a, w as words, 1 >= 6 or w >= 180 as is_full, w as last from t where i = 1
  union all select t.conv_id, t.i, t.n, case when is_full then s.i else a end, case when is_full then last else words end + t.w,
    t.i - case when is_full then s.i else a end + 1 >= 6 or case when is_full then last else words end + t.w >= 180, t.w from s join t on t.conv_id = s.conv_id and t.i = s.i + 1),
cuts as (select conv_id, a, i as z from s where is_full union all select conv_id, case when is_full then i else a end, i from s where i = n),
p as (select c.conv_id, row_number() over (partition by c.conv_id order by c.z, c.a) - 1 as part, string_agg(x, chr(10) || chr(10) order by i) as x from cuts c join t on t.conv_id = c.conv_id and i between a and z group by c.conv_id, c.a, c.z)
{_parts_sql("conv_id")} p""")
def x07_chat_chunks(spark, d):
    rows = load(spark, d, "conversations")
    line = F.concat(K.stripped(F.concat(F.col("role"), F.lit(": "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n{2,}", "\n"))), F.lit("\n"))
    return _parts(_listed(rows, "conv_id", ["turn", "role"], line), "conv_id", K.chat_chunks(F.col("text")))


@query(r"""with p as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*') as p from documents),
k as (select doc_id, p, unnest(range(0, cast(ceil(greatest(0, len(p) - 240) / 216.0) as bigint) + 1)) as k from p)
select doc_id, k as window_index, len(p[k * 216 + 1:k * 216 + 240]) as n_tokens, sha256(regexp_replace(array_to_string(p[k * 216 + 1:k * 216 + 240], ''), '^\s+|\s+$', '', 'g')) as window_sha256 from k""")
def x13_token_windows(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(K.token_windows(F.col("text"))).alias("k", "x"))
    n = F.size(F.regexp_extract_all("x", F.lit(r"\S+"), 0)).cast("long")
    return rows.select("doc_id", F.col("k").cast("long").alias("window_index"), n.alias("n_tokens"), F.sha2(F.col("x").cast("binary"), 256).alias("window_sha256"))


_SAID = "'I ordered item ' || o_orderkey || ' and I paid ' || cast(floor(o_totalprice) as bigint) || case o_orderstatus when 'F' then '; but it came late, but I kept it' when 'O' then ', I wait for it and it is late' else '. And I sent it back' end || '! Is it ' || o_orderpriority || '?'"


@query(rf"""with t as (select o_orderkey, {_SAID} as t from orders),
u as (select o_orderkey, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(t, '([.!?;])\s+', '\1' || chr(1), 'g'), '(?i),\s+((?:but\s+)?I\b)', chr(1) || '\1', 'g'),
  '(?i)\s+(and\s+I\b)', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_replace(trim(x), '(?i)^(?:and|but)\s+', '')), lambda x: x <> '') as u from t)
select o_orderkey, i as unit, x as text from (select o_orderkey, unnest(u) as x, unnest(range(len(u))) as i from u)""")
def x16_claim_units(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.expr(_SAID).alias("text"))
    return rows.select("o_orderkey", F.posexplode(K.claim_units(F.col("text"))).alias("i", "x")).select("o_orderkey", F.col("i").cast("long").alias("unit"), F.col("x").alias("text"))
