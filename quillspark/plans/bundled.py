"""Queries of bundles: what documents, sources, conversations and languages have on each benchmark text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundles as B
from ..operators import lexical
from ..sources.tables import load
from .reduce import _TOKENS_SQL
from .registry import query
from .retrieval import BM25
from .text import KEY

BUDGET = 500
_SNIPPET = r"regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), '[ \t]+(\n|\z)', '\1', 'g'), '\A\n+', ''), 1, " + str(B.SNIPPET) + r"), '[ \t\n]+\z', '')"
_FULL = f"{BM25}, full_ as (select item_id, doc_id, round(raw / max(raw) over (partition by item_id), 4) as score from raw)"
_PACKETS = """best as (select item_id, source, doc_id, score from (select item_id, source, full_.doc_id, score, row_number() over (partition by item_id, source order by score desc, full_.doc_id) as k from full_ join documents d on d.doc_id = full_.doc_id) where k = 1),
packets as (select q.item_id, s.source, b.doc_id, coalesce(score, 0) as score, row_number() over (partition by q.item_id order by coalesce(score, 0) desc, s.source nulls first) as rank
  from (select item_id from benchmark) q cross join (select distinct source from documents) s left join best b on b.item_id = q.item_id and b.source is not distinct from s.source)"""
_MEMORY = f"""memory as (select * from (select *, row_number() over (partition by item_id order by shared desc, conv_id, turn) as rank from (select item_id, conv_id, turn, count(*) as shared
  from (select item_id, unnest(list_distinct({KEY})) as term from benchmark) join (select conv_id, turn, unnest(list_distinct({KEY})) as term from conversations where role = 'user') using (term) group by all)) where rank <= {B.MEMORIES})"""


@query(f"with {_MEMORY} select item_id, conv_id, turn, shared, rank from memory")
def m16_question_memory(spark, d):
    """The user turns that share most terms with each benchmark text."""
    return B.memories(load(spark, d, "benchmark"), load(spark, d, "conversations"))


@query(f"with {_FULL}, {_PACKETS} select item_id, source, doc_id, score, case when score >= {B.ANALYZED} then 'analyzed' else 'low_relevance' end as status, rank from packets")
def m21_question_packets(spark, d):
    """The best document of every source for each benchmark text, and whether it says enough."""
    docs, asked = load(spark, d, "documents"), load(spark, d, "benchmark")
    return B.source_packets(asked, docs, lexical.bm25_scores(docs, asked)).select("item_id", "source", "doc_id", "score", "status", "rank")


@query(f"""with recursive {_FULL}, {_PACKETS}, {_MEMORY},
said as (select doc_id, lang, {_TOKENS_SQL} as cost from (select doc_id, lang, {_SNIPPET} as text from documents)),
chosen as (select item_id, 'standard' as mode, rank, doc_id, null as source, score from ranked where rank <= {B.EVIDENCE} union all select item_id, 'expanded', rank, doc_id, source, score from packets where rank <= {B.SOURCES} and doc_id is not null
  union all select item_id, 'complete', rank, doc_id, source, score from packets),
found as (select chosen.*, lang, cost from chosen left join said using (doc_id)),
rows_ as (select item_id, mode, 1 as s, 'evidence' as stream, rank, case when doc_id is not null then 'chunk:' || doc_id else 'source:' || coalesce(source, '') end as handle, score, coalesce(cost, 1) as cost from found
  union all select item_id, mode, 2, 'memory', rank, 'memory:' || conv_id || '-' || turn, shared, {_TOKENS_SQL} from memory join (select conv_id, turn, text from conversations where role = 'user') using (conv_id, turn), (select unnest({list(B.MODES)}) as mode)
  union all select item_id, mode, 3, 'cluster', row_number() over (partition by item_id, mode order by score desc, lang), 'cluster:' || lang, score, 4 from (select item_id, mode, lang, max(score) as score from found where lang is not null group by all)),
p as materialized (select *, row_number() over (partition by item_id, mode order by s, rank, handle) as place from rows_),
t as (select item_id, mode, place, cost as used, true as taken from p where place = 1
  union all select p.item_id, p.mode, p.place, case when used + cost <= {BUDGET} then used + cost else used end, used + cost <= {BUDGET} from t join p on p.item_id = t.item_id and p.mode = t.mode and p.place = t.place + 1)
select item_id, mode, place, stream, handle, score, cost, taken from p join t using (item_id, mode, place)""")
def m18_bundles(spark, d):
    """Evidence, memory and clusters for each benchmark text under one budget, in three modes."""
    return B.bundles(load(spark, d, "benchmark"), load(spark, d, "documents"), load(spark, d, "conversations"), BUDGET)
