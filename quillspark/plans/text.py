"""Queries over documents and pages: tokens, chunks, hashes, classes, keywords, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, relational
from ..sources.formats import html_title
from ..sources.tables import load
from .registry import query

TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z0-9][a-zA-Z0-9_-]{1,}'), lambda x: lower(x))"
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
KEY = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}'), lambda x: x not in ({STOP}))"
WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> '')"
SQUEEZE = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@query(f"select doc_id, cast(len({TOK}) as bigint) as n_tokens, cast(len(list_distinct({TOK})) as bigint) as n_distinct, sha256(array_to_string({TOK}, ' ')) as tokens_sha256 from documents")
def x01_tokens(spark, d):
    t = T.tokens(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.sha2(F.array_join(t, " ").cast("binary"), 256).alias("tokens_sha256"))


@query(f"""
with w as (select doc_id, {WORDS} as w from documents),
c as (select doc_id, w, unnest(range(0, cast(greatest(0, ceil((len(w) - 180) / 140.0)) as bigint) + 1)) as chunk_index from w where len(w) > 0)
select doc_id, chunk_index, cast(len(w[chunk_index * 140 + 1:chunk_index * 140 + 180]) as bigint) as n_words, sha256(array_to_string(w[chunk_index * 140 + 1:chunk_index * 140 + 180], ' ')) as chunk_sha256 from c""")
def x06_word_chunks(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(T.word_chunks(F.col("text"))).alias("i", "c"))
    return rows.select("doc_id", F.col("i").cast("long").alias("chunk_index"), F.size(F.split("c", " ")).cast("long").alias("n_words"), F.sha2(F.col("c").cast("binary"), 256).alias("chunk_sha256"))


@query(f"select doc_id, cast(greatest(1, floor(length({SQUEEZE}) / 4), ceil(round(len(regexp_extract_all({SQUEEZE}, '[A-Za-z0-9]+|[^ A-Za-z0-9]')) * 1.15, 6))) as bigint) as tokens from documents")
def x14_token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""
with s as (select doc_id, list_filter(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(9246), 'g'), chr(9246)), lambda x: x <> '') as s from documents)
select doc_id, cast(len(s) as bigint) as n_sentences, cast(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) as bigint) as longest from s""")
def x15_sentences(spark, d):
    s = T.sentences(F.col("text"))
    return load(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, F.length)), F.lit(0)).cast("long").alias("longest"))


@query(r"""
select doc_id, case when regexp_matches(text, '^[ \n]*[{\[]') then 'json' when regexp_matches(text, '(?m)^(diff --git|@@ )') then 'diff' when regexp_matches(text, '(?m)^#{1,6} ') then 'markdown'
  when regexp_matches(text, '(?m)^(user|assistant|system):') then 'conversation' when regexp_matches(text, '(?m)^\d{4}-\d\d-\d\d[T ]\d\d:\d\d') then 'log' when regexp_matches(text, '\|.*\|.*\|') then 'table'
  when regexp_matches(text, '(def |function |class )[A-Za-z_]+') then 'code' else 'prose' end as profile from documents""")
def f08_content_profile(spark, d):
    return load(spark, d, "documents").select("doc_id", T.content_profile(F.col("text")).alias("profile"))


@query(r"""
select doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\s+[a-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'),
  '(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[^\s,;]+', '\1=[redacted]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '(https?://)[^/\s:@]+:[^/\s@]+@', '\1[redacted]@', 'g')) as redacted_sha256 from documents""")
def f11_redaction(spark, d):
    return load(spark, d, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")).cast("binary"), 256).alias("redacted_sha256"))


@query(f"select doc_id, sha256({SQUEEZE}) as content_sha256 from documents")
def f20_content_hash(spark, d):
    return load(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_sha256"))


@query("""
with k as (select doc_id, case cast(regexp_extract(source, '[0-9]+', 0) as int) % 4 when 0 then 'document' when 1 then 'artifact' when 2 then 'transcript' else 'chat' end as class, case when n_chars < 500 then 'low' when n_chars < 2000 then 'medium' else 'high' end as tier from documents)
select doc_id, class, tier, case class when 'document' then 1.0::double when 'artifact' then 0.85::double when 'transcript' then 0.72::double else 0.65::double end as class_weight, case when tier = 'low' then 0.55::double when tier = 'medium' then 0.85::double else 1.0::double end as trust_weight from k""")
def f05_f07_weights(spark, d):
    k = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 4
    docs = load(spark, d, "documents").select("doc_id", F.when(k == 0, "document").when(k == 1, "artifact").when(k == 2, "transcript").otherwise("chat").alias("class"), F.when(F.col("n_chars") < 500, "low").when(F.col("n_chars") < 2000, "medium").otherwise("high").alias("tier"))
    return docs.select("doc_id", "class", "tier", T.class_weight(F.col("class")).alias("class_weight"), T.trust_weight(F.col("tier"), F.array(F.lit("none"))).alias("trust_weight"))


@query(f"""
with e as (select doc_id, unnest({KEY}) as term, unnest(range(len({KEY}))) as pos from documents),
c as (select doc_id, term, count(*) as tf, min(pos) as first from e group by all)
select doc_id, rank, term, tf from (select *, row_number() over (partition by doc_id order by tf desc, first) as rank from c) where rank <= 8""")
def g05_keywords(spark, d):
    return lexical.keywords(load(spark, d, "documents"))


@query(f"select term, count(*) as df from (select doc_id, unnest(list_distinct({TOK})) as term from documents) group by term")
def g06_document_frequency(spark, d):
    return lexical.document_frequency(load(spark, d, "documents"))


@query(f"select count(*) as n, round(avg(len({TOK})), 6) as avgdl, cast(max(len({TOK})) as bigint) as longest from documents")
def g07_corpus_stats(spark, d):
    n = F.size(T.tokens(F.col("text")))
    return load(spark, d, "documents").select(n.alias("dl")).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").cast("long").alias("longest"))


@query(f"""
with n as (select source, count(*) as n from documents group by source),
e as (select source, term, count(*) as df from (select source, unnest(list_distinct({KEY})) as term from documents) group by all),
r as (select *, row_number() over (partition by source order by df desc, term) as rank from e)
select r.source, term, round(df / n, 6) as weight from r join n on r.source = n.source where rank <= 32""")
def g13_term_profile(spark, d):
    return lexical.term_profile(load(spark, d, "documents"), "source")


@query(f"""
select source, arg_max(doc_id, (n_chars, -doc_id)) as doc_id, max(n_chars) as n_chars from documents group by source""")
def g09_longest_per_source(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"), F.max("n_chars").alias("n_chars"))


@query(f"""select doc_id, copies from (select doc_id, row_number() over (partition by sha256({SQUEEZE}) order by doc_id) as r, count(*) over (partition by sha256({SQUEEZE})) as copies from documents) where r = 1""")
def u05_exact_dedupe(spark, d):
    return load(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(f"""select d.doc_id from documents d where d.lang = 'en' and sha256({SQUEEZE}) not in (select sha256({SQUEEZE}) from documents where lang <> 'en')""")
def u06_checksum_dedupe(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", T.content_hash(F.col("text")).alias("h"))
    return docs.where("lang = 'en'").join(docs.where("lang <> 'en'").select("h"), "h", "left_anti").select("doc_id")


@query(r"select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\r\n]+', ' ', 'g'), ' ') as title from pages")
def s05_html_title(spark, d):
    return load(spark, d, "pages").select("page_id", html_title(F.col("html")).alias("title"))


@query(r"""
with p as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as p from pages),
a as (select page_id, array_to_string(p[1:k], '/') as folder, k = len(p) - 1 as direct from (select page_id, p, unnest(range(1, len(p))) as k from p))
select folder, count(*) as total, count(*) filter (direct) as direct from a group by folder""")
def g33_folder_rollup(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    rows = load(spark, d, "pages").select(relational.ancestors(path).alias("a")).select(F.size("a").alias("n"), F.posexplode("a").alias("i", "folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("total"), F.count_if(F.col("i") == F.col("n") - 1).alias("direct"))


@query("select source, count(*) as n, cast(sum(length(text)) as bigint) as chars, cast(sum(strlen(text)) as bigint) as bytes from documents group by source")
def g15_byte_accounting(spark, d):
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


@query("""select event_type, k, count(*) as n, round(sum(value), 2) as total from (select event_type, value, unnest(json_keys(props)) as k from events) group by all""")
def x31_json_event_keys(spark, d):
    e = load(spark, d, "events").select("event_type", "value", F.explode(F.json_object_keys("props")).alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""
select conv_id, turn, s.i - 1 as sentence, case when regexp_matches(s.x, '(?i)(prefer|like|love|favou?rite)') then 'preference' when regexp_matches(s.x, '(?i)(decid|will |plan)') then 'decision' when regexp_matches(s.x, '[0-9]') then 'quantity' else 'fact' end as kind, length(s.x) as chars
from (select conv_id, turn, unnest(list_transform(list_filter(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(9246), 'g'), chr(9246)), lambda x: x <> ''), lambda x, i: {'x': x, 'i': i})) as s from conversations where role = 'user') where length(s.x) >= 30""")
def x19_memory_candidates(spark, d):
    rows = load(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("i", "x")).where(F.length("x") >= 30)
    kind = F.when(F.col("x").rlike("(?i)(prefer|like|love|favou?rite)"), "preference").when(F.col("x").rlike("(?i)(decid|will |plan)"), "decision").when(F.col("x").rlike("[0-9]"), "quantity").otherwise("fact")
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("sentence"), kind.alias("kind"), F.length("x").cast("long").alias("chars"))
