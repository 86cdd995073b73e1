"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit, chat, decontam, fingerprint, hardneg, html, jaccard, langid, linededup, merkle, mixing, quality, sharding
from .common import table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    where = (F.col(f"pieces.{c}").alias(f"piece_{c}") for c in ("shard", "block", "place"))
    return got.select("doc_id", "size", "source_size", "target", "taken", *where)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out("doc_id", 5, 0)
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(~out))
    return quality.score(docs, weights).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out("doc_id", 4, 2)
    model = langid.train(docs.where(~out))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(planted)))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = merkle.manifest(docs, tampered={"text": merkle.lower_cased(F.col("doc_id"), F.col("text"))})
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = bestfit.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix, op2_fingerprint, op3_html, op4_quality, op5_decontaminate, op6_language, op7_jaccard, op8_shard, op9_linededup, op10_chat,
        op11_manifest, op12_pack, op13_negatives,
    )
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Levels of the SQL's trees: enough for 8 ** 7 rows of a language.
_LEVELS = 7


def _manifest_sql() -> str:
    """The tree level by level, each leaf's run at each level, and the CRC-32 bit by bit."""

    def said(c: str) -> str:
        return f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')"

    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf, other = (" || ".join([*map(said, ("doc_id", "source", "lang", "n_chars")), said(t)]) for t in ("text", small))
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda r, j: xor(r >> 1, (r & 1) * 3988292384))"
    code = f"list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint)), lambda c, b: {bits})"
    sql = [
        f"d as (select doc_id, coalesce('1' || lang, '0') as grp, sha256({leaf}) as leaf, case when xor({code}, 4294967295::bigint) % 3 = 0 then sha256({other}) else sha256({leaf}) end as start from documents)",
        "a0 as (select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i from d)",
        "n0 as (select grp, i, leaf as h, count(*) over (partition by grp) as n from a0)",
    ]

    def grown(nodes: str, k: int) -> str:
        return f"{nodes}{k + 1} as (select grp, i // 8 as i, case when max(n) = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h, (max(n) + 7) // 8 as n from {nodes}{k} group by grp, i // 8)"

    sql += [grown("n", k) for k in range(_LEVELS)]
    sql += [f"top as (select grp as member, h as subroot, row_number() over (order by grp) - 1 as i from n{_LEVELS})", "m0 as (select '' as grp, i, subroot as h, count(*) over () as n from top)"]
    sql += [grown("m", k) for k in range(_LEVELS)]

    def folded(rows: str, nodes: str, k: int, keep: str) -> str:
        """A row's digest and siblings one level up."""
        run = f"select r.*, s.i = r.i as own, s.h as sh, s.i as si, s.n as sn from {rows}{k} r join {nodes}{k} s on s.grp = r.grp and s.i // 8 = r.i // 8"
        return (
            f"{rows}{k + 1} as (select rid, grp, i // 8 as i, {keep}, case when max(sn) = 1 then max(start) else sha256(string_agg(case when own then start else sh end, '' order by si)) end as start,"
            f" max(path) || coalesce(string_agg(case when not own then sh end, '' order by si), '') as path from ({run}) group by rid, grp, i, {keep})"
        )

    sql.append("r0 as (select row_number() over () as rid, grp, i, doc_id, leaf, start, '' as path from a0)")
    sql += [folded("r", "n", k, "doc_id, leaf") for k in range(_LEVELS)]
    sql.append(f"q0 as (select rid, '' as grp, top.i, doc_id, leaf, subroot, start, path from r{_LEVELS} r join top on top.member = r.grp)")
    sql += [folded("q", "m", k, "doc_id, leaf, subroot") for k in range(_LEVELS)]
    return (
        "with " + ",\n".join(sql) + f"\nselect doc_id, leaf, subroot, h as root, sha256(path) as proof_sha256, start as folded_root, start = h as verified from q{_LEVELS} cross join (select h from m{_LEVELS})"
    )


ORACLES = {
    "op11_manifest": _manifest_sql(),
    "op13_negatives": """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label as al, b.vec_id as id, b.label as bl, cast(list_dot_product(a.v, b.v) as bigint) as score
      from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where al = bl qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.*, id as negative_id, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank
      from p join s using (anchor_id) where al <> bl and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
""",
    "op5_decontaminate": f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
bw as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
       from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
hit as (select doc_id, i, dw.n, item from dw join bw on dw.n = bw.n and dw.win = bw.win),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from hit) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id
""",
    "op9_linededup": r"""
with l as (select doc_id, text, string_split(text, chr(10)) as l from documents),
w as (select doc_id, i - 1 as pos, array_to_string(l[i:i + 2], chr(10)) as win from (select doc_id, l, unnest(range(1, len(l) - 1)) as i from l where len(l) >= 3)),
f as (select win, min((doc_id, pos)) as first, count(*) as c from w group by win having count(*) > 1),
cov as (select distinct doc_id, unnest(range(pos, pos + 3)) as pos from w join f using (win) where (w.doc_id, w.pos) <> f.first),
n as (select doc_id, count(*) as n_removed from cov group by doc_id),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as text
         from (select doc_id, i - 1 as pos, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from l)) x anti join cov using (doc_id, pos) group by doc_id)
select l.doc_id, case when l.text is not null then cast(len(l.l) as bigint) end as n_lines,
       case when l.text is not null then coalesce(n_removed, 0) end as n_removed, case when l.text is not null then coalesce(kept.text, '') end as text
from l left join n on l.doc_id = n.doc_id left join kept on l.doc_id = kept.doc_id
""",
    "op10_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(role) + length(replace(role, '\', '\\')) - length(role) + length(replace(text, '\', '\\'))
        + len(regexp_extract_all(replace(role, '\', '\\'), '<\|turn\|>|<\|says\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
        + len(regexp_extract_all(replace(text, '\', '\\'), '<\|turn\|>|<\|says\|>|<\|end\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + 24 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars, false as rewrites_history
from e group by conv_id
""",
}
