"""Queries over files, settings, statements and logs; their texts are rendered from the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files as S
from ..sources import formats
from ..sources.tables import load
from .registry import query

URL_PATH = r"regexp_replace(regexp_replace(url, '^https?://[^/]*/?', ''), '[?#].*$', '')"
IGNORE = ["# build output", "!kept", "/fr", "de/1*", "*7", "9?"]
IGNORED = "regexp_matches(path, '^(fr|.*/fr)$') or starts_with(path, 'fr/') or regexp_matches(path, '(^|/)fr(/|$)') or regexp_matches(path, '^(.*/)?de/1.*$') or regexp_matches(path, '^.*7$') or regexp_matches(path, '(^|/)[^/]*7(/|$)') or regexp_matches(path, '^(.*/)?9.$') or regexp_matches(path, '(^|/)9[^/](/|$)')"


def _written(spark, rows, name: str) -> str:
    """``rows`` (value) as text files in a fresh folder of the shared one."""
    mark = spark.range(1).select(F.uuid()).first()[0]
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{mark}"
    rows.write.text(path)
    return path


@query("""select doc_id, case when doc_id % 3 = 0 and regexp_matches(text, '[^\\x00-\\x7f]') and not regexp_matches(text, '[^\\x00-\\x7f\\xa0-\\xff]') then 'cp1252' else 'utf-8' end as charset, sha256(text) as text_sha256
from documents where text is not null""")
def s02_decoded_text(spark, d):
    """Every third text as bytes of Latin-1 where these have all its characters, the others as UTF-8."""
    docs = load(spark, d, "documents").where("text is not null")
    narrow = (F.col("doc_id") % 3 == 0) & ~F.col("text").rlike(r"[^\x00-\x7f\xa0-\xff]")
    raw = F.when(narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return S.decoded(docs.select("doc_id", raw.alias("content"))).select("doc_id", "charset", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


MARKDOWN = "'---' || chr(10) || 'title: ' || p_name || chr(10) || 'brand: ' || p_brand || chr(10) || '---' || chr(10) || 'Intro ' || p_size || chr(10) || '# ' || p_type || chr(10) || 'Price' || chr(10) || case when p_size > 25 then '## Large' || chr(10) || 'Yes' else '' end"


@query(f"""select p_partkey, 'title: ' || p_name || chr(10) || 'brand: ' || p_brand as front, case when p_size > 25 then 3 else 2 end as sections, sha256(split_part({MARKDOWN}, '---' || chr(10), 3)) as body_sha256 from part""")
def s04_front_matter(spark, d):
    rows = load(spark, d, "part").select("p_partkey", F.expr(MARKDOWN).alias("text"))
    front, body = formats.front_matter(F.col("text"))
    return rows.select("p_partkey", front.alias("front"), F.size(formats.markdown_sections(body)).cast("long").alias("sections"), F.sha2(body.cast("binary"), 256).alias("body_sha256"))


@query(f"""with p as (select page_id, {URL_PATH} as path from pages) select page_id, path, {IGNORED} as ignored from p""")
def s18_ignored_paths(spark, d):
    rows = load(spark, d, "pages").select("page_id", F.expr(URL_PATH).alias("path"))
    return rows.select("page_id", "path", S.ignored(F.col("path"), IGNORE).alias("ignored"))


FILE_PATH = "case when page_id % 11 = 0 then 'conf/.env.' || page_id when page_id % 13 = 0 then 'keys/' || page_id || '.pem' else 'src/' || page_id || case page_id % 4 when 0 then '.py' when 1 then '.ts' when 2 then '.md' else '.html' end end"
FILE_CONTENT = "case when page_id % 17 = 0 then '' when page_id % 19 = 0 then '%PDF-1.7 ' || html else html end"
REJECTED = "case when content is null or content = '' then 'empty' when page_id % 11 = 0 or page_id % 13 = 0 then 'secret' when strlen(content) > 20000 then 'too_large' when starts_with(content, '%PDF') then 'archive' end"


@query(f"with f as (select page_id, {FILE_PATH} as path, {FILE_CONTENT} as content from pages) select page_id, path, {REJECTED} as reason from f")
def s27_rejected_files(spark, d):
    rows = load(spark, d, "pages").select("page_id", F.expr(FILE_PATH).alias("path"), F.expr(FILE_CONTENT).alias("content"))
    return rows.select("page_id", "path", S.rejection(F.col("path"), F.col("content"), 20_000).alias("reason"))


@query(f"""with f as (select page_id, {FILE_PATH} as path, {FILE_CONTENT} as content from pages), m as (select * from f where {REJECTED} is null)
select path, case regexp_extract(path, '[.]([a-z]+)$', 1) when 'py' then 'python' when 'ts' then 'typescript' when 'md' then 'markdown' else 'html' end as language, strlen(content) as bytes, sha256(content) as content_sha256 from m""")
def s17_manifest(spark, d):
    rows = load(spark, d, "pages").select(F.expr(FILE_PATH).alias("path"), F.expr(FILE_CONTENT).alias("content"))
    rows = rows.where(S.rejection(F.col("path"), F.col("content"), 20_000).isNull())
    return rows.select("path", S.language(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("bytes"), F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"))


SETTINGS = """'{ // of event ' || event_id || chr(10) || '"' || event_type || '": 1, /* note */ "url": "http://x/*y*/", "deep": {"k": 2}' || case when event_id % 5 = 0 then ', "fifth": true' else '' end || '}'"""


@query("""select k as name, count(*) as n from (select unnest(case when event_id % 5 = 0 then [event_type, 'url', 'deep', 'fifth'] else [event_type, 'url', 'deep'] end) as k from events) group by k""")
def s22_settings_keys(spark, d):
    keys = F.json_object_keys(S.without_comments(F.expr(SETTINGS)))
    return load(spark, d, "events").select(F.explode(keys).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


LISTS = """case event_id % 5 when 0 then '["' || event_type || '", "b"]' when 1 then props when 2 then 'not json' when 3 then '[]' end"""


@query("select event_id, case when event_id % 5 = 0 then 2 else 0 end as n, case when event_id % 5 = 0 then event_type end as first from events")
def x32_json_lists(spark, d):
    items = S.json_list(F.expr(LISTS))
    return load(spark, d, "events").select("event_id", F.size(items).cast("long").alias("n"), F.get(items, F.lit(0)).alias("first"))


STATEMENT = """case o_orderkey % 5 when 0 then 'SELECT * FROM orders_' || o_custkey % 7 || ' JOIN Customer c ON true join "part" p on true JOIN orders_' || o_custkey % 7
  when 1 then 'insert  into ' || lower(o_orderpriority[3:6]) || '_t SELECT * from stage' when 2 then 'UPDATE `stock` SET a = 1' when 3 then 'delete from old.rows_' || o_custkey % 3 else 'select a from t1 join t2 on x join t3 on y join t4 on z join t5 on w' end"""
STATEMENT_SPARK = STATEMENT.replace("o_orderpriority[3:6]", "substring(o_orderpriority, 3, 4)")


@query(f"""with s as (select o_orderkey, regexp_extract_all({STATEMENT}, '(?i)\\b(?:from|join|into|update)\\s+["''`\\[]?([A-Za-z_][\\w.$-]*)', 1) as t from orders),
u as (select o_orderkey, x, min(i) as i from (select o_orderkey, unnest(t) as x, generate_subscripts(t, 1) as i from s) group by all),
r as (select *, row_number() over (partition by o_orderkey order by i) as place from u)
select o_orderkey, place, x as table_name, case when o_orderkey % 5 in (1, 2, 3) then 'writes_data' else 'reads_data' end as edge from r where place <= 4""")
def x34_sql_lineage(spark, d):
    rows = load(spark, d, "orders").select("o_orderkey", F.expr(STATEMENT_SPARK).alias("s"))
    each = rows.select("o_orderkey", S.sql_edge(F.col("s")).alias("edge"), F.posexplode(S.sql_tables(F.col("s"))).alias("i", "table_name"))
    return each.select("o_orderkey", (F.col("i") + 1).cast("long").alias("place"), "table_name", "edge")


@query("""select o_orderkey as commit, o_custkey as author, strftime(o_orderdate, '%Y-%m-%d') as day, 'src/' || l_partkey || '.py' as path, cast(l_quantity as bigint) as added, case when l_returnflag = 'R' then null else l_linenumber end as deleted
from orders join lineitem on l_orderkey = o_orderkey""")
def s19_git_log(spark, d):
    """Orders as commits and their lines as changed files, written as a log and read back."""
    li = load(spark, d, "lineitem")
    name = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("src/{old => "), F.col("l_partkey").cast("string"), F.lit("}.py"))).otherwise(F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit(".py")))
    gone = F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_linenumber").cast("string"))
    stat = li.select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), gone, name).alias("f")).groupBy("o_orderkey").agg(F.array_join(F.collect_list("f"), "\n").alias("f"))
    head = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit("order "), "o_orderstatus"))
    text = load(spark, d, "orders").join(stat, "o_orderkey").select(F.concat(F.lit("\x1e"), head, F.lit("\x1f\n"), "f").alias("value"))
    rows = formats.git_log(spark, _written(spark, text, "log"))
    return rows.select(F.col("commit").cast("long").alias("commit"), F.col("author").cast("long").alias("author"), F.date_format("at", "yyyy-MM-dd").alias("day"), "path", "added", "deleted")


@query("""select 't' || l_suppkey as test, 'src/' || l_partkey || '.py' as path, l_linenumber as line, bool_or(l_returnflag = 'A') as covered from lineitem group by all""")
def s20_coverage_records(spark, d):
    """Suppliers as tests that hit lines of parts, written as coverage records and read back."""
    li = load(spark, d, "lineitem")
    line = F.concat(F.lit("DA:"), F.col("l_linenumber").cast("string"), F.lit(","), F.when(F.col("l_returnflag") == "A", "3").otherwise("0"))
    one = li.groupBy("l_suppkey", "l_partkey").agg(F.array_join(F.collect_list(line), "\n").alias("d"))
    text = one.select(F.concat(F.lit("TN:t"), F.col("l_suppkey").cast("string"), F.lit("\nSF:src/"), F.col("l_partkey").cast("string"), F.lit(".py\n"), "d", F.lit("\nend_of_record")).alias("value"))
    rows = formats.lcov(spark, _written(spark, text, "coverage"))
    return rows.select("test", "path", F.col("line").cast("int").alias("line"), "covered")
