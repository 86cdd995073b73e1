"""Queries that score, rank, measure and pack."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical, packing, relational, vector
from ..sources.tables import load
from .registry import query
from .text import SQUEEZE, TOK

BM25 = f"""
docs as (select doc_id, {TOK} as t from documents), st as (select count(*) as n, avg(len(t)) as avgdl from docs),
q as (select item_id, term, count(*) as qtf from (select item_id, unnest({TOK}) as term from benchmark) group by all),
tf as (select doc_id, dl, term, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from docs) where term in (select term from q) group by all),
df as (select term, count(*) as df from tf group by term),
w as (select tf.doc_id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as w from tf join df on tf.term = df.term, st),
raw as (select item_id, doc_id, sum(w * qtf) as raw from w join q on w.term = q.term group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from (select item_id, doc_id, round(raw / max(raw) over (partition by item_id), 4) as score from raw))"""


@query(f"with {BM25} select item_id, doc_id, score, rank from ranked where rank <= 5")
def g08_bm25_topk(spark, d):
    return lexical.bm25(load(spark, d, "documents"), load(spark, d, "benchmark")).select("item_id", "doc_id", "score", "rank")


@query(f"""with {BM25}, gold as (select b.item_id, min(doc_id) as gold from benchmark b join documents d on contains(d.text, b.text) group by 1),
r as (select gold.item_id, rank from gold left join (select * from ranked where rank <= 10) x on gold.item_id = x.item_id and gold.gold = x.doc_id)
select count(*) as n, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as hit1, round(avg(case when rank <= 10 then 1.0 else 0.0 end), 6) as hit10, round(avg(coalesce(1.0 / rank, 0)), 6) as mrr10, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) as ndcg10 from r""")
def g26_rank_metrics(spark, d):
    docs, items = load(spark, d, "documents"), load(spark, d, "benchmark")
    # gold: the first document that holds the item's text; items are a stated query set, matched by their first sentence's words
    from ..operators.containment import first_containing

    gold = first_containing(docs, items)
    ranked = lexical.bm25(docs, items, k=10)
    r = gold.join(ranked.select("item_id", F.col("doc_id").alias("gold"), "rank"), ["item_id", "gold"], "left")
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return r.agg(F.count("*").alias("n"), hit(1).alias("hit1"), hit(10).alias("hit10"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr10"), F.round(F.avg(F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0))), 6).alias("ndcg10"))


VEC = """
s as (select q.vec_id as query_id, c.vec_id as id, c.label, round(list_dot_product(q.embedding::double[], c.embedding::double[]), 4) as score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s where score > 0)"""


def _vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"with {VEC} select query_id, id, score, rank from r where rank <= 5")
def k01_vector_topk(spark, d):
    v = _vectors(spark, d)
    return vector.top_k(v.where("id % 20 = 0"), v)


@query(f"""with {VEC}, a as (select query_id, id, label, score, rank, row_number() over (partition by query_id, label order by score desc, id) as place from r where rank <= 50)
select query_id, label, id, score, place from a where place <= 3""")
def k05_per_class_topk(spark, d):
    v = _vectors(spark, d)
    hits = vector.top_k(v.where("id % 20 = 0"), v, k=50).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    return relational.top_per_key(hits.drop("rank"), ["query_id", "label"], [F.desc("score"), F.col("id")], 3, "place").select("query_id", "label", "id", "score", "place")


@query(f"""with {VEC}, a as (select query_id, id, label, score, row_number() over (partition by query_id, label order by score desc, id) as place from r where rank <= 50)
select query_id, id, score, rank from (select *, row_number() over (partition by query_id order by case when place = 1 then 0 else 1 end, score desc, id) as rank from a) where rank <= 10""")
def k06_diverse_topk(spark, d):
    v = _vectors(spark, d)
    hits = vector.top_k(v.where("id % 20 = 0"), v, k=50).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").drop("rank")
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "label").orderBy(F.desc("score"), "id")))
    return relational.top_per_key(placed, ["query_id"], [F.when(F.col("place") == 1, 0).otherwise(1), F.desc("score"), F.col("id")], 10).select("query_id", "id", "score", "rank")


@query(f"""with {VEC}, h as (select q.vec_id as query_id, c.vec_id as id, round(list_dot_product(q.embedding[1:32]::double[], c.embedding[1:32]::double[]), 4) as score from embeddings q, embeddings c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
hr as (select *, row_number() over (partition by query_id order by score desc, id) as rank from h where score > 0)
select r.query_id, count(hr.id) as shared, round(count(hr.id) / 10.0, 6) as overlap from (select * from r where rank <= 10) r left join (select * from hr where rank <= 10) hr on r.query_id = hr.query_id and r.id = hr.id group by r.query_id""")
def g30_topk_overlap(spark, d):
    v = _vectors(spark, d)
    half = v.select("id", F.slice("v", 1, 32).alias("v"))
    a, b = vector.top_k(v.where("id % 20 = 0"), v, k=10), vector.top_k(half.where("id % 20 = 0"), half, k=10)
    both = a.select("query_id", "id").join(b.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("hit").alias("shared"), F.round(F.count("hit") / 10.0, 6).alias("overlap"))


@query(f"""with {VEC} select query_id, t.threshold, count(*) filter (score >= t.threshold) as passing, count(distinct label) filter (score >= t.threshold) as labels from r, (select unnest([0.2, 0.4, 0.6])::double as threshold) t where rank <= 50 group by all""")
def g31_threshold_sweep(spark, d):
    v = _vectors(spark, d)
    hits = vector.top_k(v.where("id % 20 = 0"), v, k=50).join(load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    swept = hits.withColumn("threshold", F.explode(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.6))))
    ok = F.col("score") >= F.col("threshold")
    return swept.groupBy("query_id", "threshold").agg(F.count_if(ok).alias("passing"), F.count_distinct(F.when(ok, F.col("label"))).alias("labels"))


CEN = "c as (select label, dim, avg(x::double) as value from (select label, unnest(embedding) as x, unnest(range(len(embedding))) as dim from embeddings) group by all), cv as (select label, list(value order by dim) as centroid from c group by label)"


@query(f"with {CEN} select label, dim, round(value, 6) as value from c")
def g10_centroids(spark, d):
    return vector.centroids(load(spark, d, "embeddings"), "label").select("label", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(f"with {CEN} select e.label, count(*) as n, round(avg(list_dot_product(embedding::double[], centroid)), 6) as cohesion from embeddings e join cv on e.label = cv.label group by e.label")
def g11_cohesion(spark, d):
    return vector.cohesion(load(spark, d, "embeddings"), "label")


@query(f"""with {CEN}, s as (select vec_id, cv.label, round(list_dot_product(embedding::double[], centroid), 6) as s from embeddings, cv),
r as (select *, row_number() over (partition by vec_id order by s desc, label) as k, lead(s) over (partition by vec_id order by s desc, label) as nxt from s)
select vec_id, label as best, s as score, round(s - nxt, 6) as margin, s - nxt >= 0.12 and s >= 0.58 as moves from r where k = 1""")
def w12_margin_to_runner_up(spark, d):
    v = load(spark, d, "embeddings")
    cents = vector.centroid_vectors(v, "label")  # one row a label: Spark broadcasts it if it is small enough
    s = v.select("vec_id", "embedding").crossJoin(cents).select("vec_id", "label", F.round(vector.dot(F.col("embedding"), F.col("centroid")), 6).alias("s"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("s"), "label")
    best = s.withColumn("k", F.row_number().over(w)).withColumn("nxt", F.lead("s").over(w)).where("k = 1")
    gap = F.col("s") - F.col("nxt")
    return best.select("vec_id", F.col("label").alias("best"), F.col("s").alias("score"), F.round(gap, 6).alias("margin"), ((gap >= 0.12) & (F.col("s") >= 0.58)).alias("moves"))


SIMILAR = f"""with {CEN} select a.label as a, b.label as b, round(list_dot_product(a.centroid, b.centroid) / sqrt(list_dot_product(a.centroid, a.centroid) * list_dot_product(b.centroid, b.centroid)), 4) as similarity from cv a join cv b on a.label < b.label"""


@query(SIMILAR)
def j08_similar_clusters(spark, d):
    c = vector.centroid_vectors(load(spark, d, "embeddings"), "label")
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("u")), c.select(F.col("label").alias("b"), F.col("centroid").alias("v"))
    cos = vector.dot(F.col("u"), F.col("v")) / F.sqrt(vector.dot(F.col("u"), F.col("u")) * vector.dot(F.col("v"), F.col("v")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(cos, 4).alias("similarity"))


@query(f"""with recursive t as (select conv_id, turn, cast(greatest(1, floor(length({SQUEEZE}) / 4), ceil(round(len(regexp_extract_all({SQUEEZE}, '[A-Za-z0-9]+|[^ A-Za-z0-9]')) * 1.15, 6))) as bigint) as tokens from conversations),
p as materialized (select *, row_number() over (partition by conv_id order by tokens desc, turn) as place from t),
s as (select conv_id, place, case when tokens <= 400 then tokens else 0 end as used, tokens <= 400 as taken from p where place = 1
  union all select p.conv_id, p.place, case when used + tokens <= 400 then used + tokens else used end, used + tokens <= 400 from s join p on p.conv_id = s.conv_id and p.place = s.place + 1)
select conv_id, turn, tokens, taken from p join s using (conv_id, place)""")
def w14_budget_pack(spark, d):
    """Turns of each conversation packed, longest first, into 400 tokens; skips what does not fit."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("tokens"), "turn")))
    return packing.pack(rows, "conv_id", "place", "tokens", 400).select("conv_id", "turn", "tokens", "taken")


@query("""with l as (select conv_id, turn, role, length(text) as n, lag(length(text)) over w as before, lead(length(text)) over w as behind from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, n > 600 or coalesce(before > 600, false) or coalesce(behind > 600, false) as selected from l""")
def w13_adjacent_expansion(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    hit = F.length("text") > 600
    return load(spark, d, "conversations").select("conv_id", "turn", (hit | F.coalesce(F.lag(hit).over(w), F.lit(False)) | F.coalesce(F.lead(hit).over(w), F.lit(False))).alias("selected"))


@query("""select conv_id, turn, n, rank from (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by length(text) desc, turn) as rank from conversations where role = 'assistant') where rank <= 2""")
def w11_per_session_cap(spark, d):
    rows = load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return relational.top_per_key(rows, ["conv_id"], [F.desc("n"), F.col("turn")], 2)


#: Vectors of an item, and which items ask.
TOKENS, ASKING = 4, 10


@query(f"""with t as (select vec_id // {TOKENS} as id, vec_id % {TOKENS} as pos, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
p as (select q.id as query_id, c.id, q.pos, max(list_dot_product(q.v, c.v)) as best from t q join t c on q.id % {ASKING} = 0 and q.id <> c.id group by all), s as (select query_id, id, round(sum(best), 4) as score from p group by all),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s) select query_id, id, score, rank from r where rank <= 5""")
def k17_token_interaction(spark, d):
    """Late interaction of items of four vectors each: each tenth item asks all others."""
    t = load(spark, d, "embeddings").select(F.floor(F.col("vec_id") / TOKENS).alias("id"), (F.col("vec_id") % TOKENS).alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return vector.late_interaction(t.where(F.col("id") % ASKING == 0), t)
