"""Term statistics, keywords and BM25 as joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled

K1, B = 1.5, 0.75
#: Query terms (of all queries) up to which their weights are broadcast, about 60 bytes each.
BROADCAST_TERMS = 1_000_000
#: Pairs of a document and a query that a task sums, some 100 bytes each, and the most tasks.
PAIRS, MOST_TASKS = 1_000_000, 20_000


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf); terms of a document are counted in its own row before any shuffle."""
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df): documents with the term; distinct per row, so one shuffle of counts is enough."""
    return docs.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def keywords(docs: DataFrame, k: int = 8) -> DataFrame:
    """(doc_id, rank, term, tf): most frequent keywords, ties by first place."""
    each = docs.select("doc_id", F.posexplode(T.keyword_tokens(F.col("text"))).alias("pos", "term"))
    counted = each.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("tf"), "first"))
    return counted.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("doc_id", "rank", "term", "tf")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, digits: int = 4) -> DataFrame:
    """(item_id, doc_id, score, rank): best ``k`` documents of each query, ties by doc_id; each task sends its best ``k`` of a query."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return bm25_scores(docs, queries, digits).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, digits: int = 4) -> DataFrame:
    """(item_id, doc_id, score) of every document that has a term of the query.

    Repeated query terms count repeatedly; scores are divided by the query's
    best and rounded.  The text is read once and cut down to query terms before
    anything is shuffled; scores are summed where a document's terms stand.  The
    number of tasks grows with documents times queries, so that a task's sums
    take no more memory over more documents.
    """
    terms = queries.select("item_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("qtf"))
    wanted = terms.select("term").distinct().withColumn("found", F.col("term"))
    each = docs.select("doc_id", F.explode_outer(T.tokens(F.col("text"))).alias("term"))
    # the one pass over the text: (doc_id, term, tf) of the query terms, all other tokens of a document under null
    counts = settled(each.join(wanted, "term", "left").groupBy("doc_id", F.col("found").alias("term")).agg(F.count("term").alias("tf")))
    pairs = counts.agg(F.approx_count_distinct("doc_id")).first()[0] * terms.agg(F.approx_count_distinct("item_id")).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-pairs // PAIRS)))
    counts = counts.repartition(tasks, "doc_id").select("doc_id", "term", "tf", F.sum("tf").over(Window.partitionBy("doc_id")).alias("dl"))
    stats = counts.groupBy("doc_id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = counts.where("term is not null")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    weights = terms.join(df, "term").crossJoin(F.broadcast(stats)).select("item_id", "term", "qtf", "avgdl", idf.alias("idf"))
    weights = settled(weights)
    weights_fit = weights.count() <= BROADCAST_TERMS  # and so are the queries, of which each has a term here
    if weights_fit:
        weights = F.broadcast(weights)
    one = F.col("idf") * F.col("tf") * (K1 + 1) / norm
    raw = found.join(weights, "term").groupBy("item_id", "doc_id").agg(F.sum(one * F.col("qtf")).alias("raw"))
    raw = raw.repartition(tasks, "item_id", "doc_id")  # an exchange that both uses below read: the sums are made once
    best = raw.groupBy("item_id").agg(F.max("raw").alias("top"))
    return raw.join(F.broadcast(best) if weights_fit else best, "item_id").select("item_id", "doc_id", F.round(F.col("raw") / F.col("top"), digits).alias("score"))


def term_profile(docs: DataFrame, key: str, k: int = 32) -> DataFrame:
    """(key, term, weight): share of the key's documents that have the keyword; top ``k``."""
    sizes = docs.groupBy(key).agg(F.count("*").alias("n"))
    each = docs.select(key, F.explode(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("df"), "term"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).join(sizes, key).select(key, "term", F.round(F.col("df") / F.col("n"), 6).alias("weight"))
