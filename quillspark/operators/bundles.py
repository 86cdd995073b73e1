"""Bundles of evidence for questions: several streams of candidates under one budget of tokens.

The streams of a question are its best documents, or the best document of
each source, what memory has on it, and the clusters these stand in.  In mode
``standard`` evidence is the best documents; ``expanded`` takes the best
document of each of the best sources; ``complete`` goes through every source,
those without a hit included, and says which are of low relevance.  Streams
come in this order, by rank; a candidate that does not fit the budget is
passed over.  Questions are a stated set; what is joined to them are the
documents and memories that share a term with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled
from . import lexical
from .packing import pack

#: Evidence and sources of a bundle, memories, characters of a snippet, score of a source that counts as analyzed.
EVIDENCE, SOURCES, MEMORIES, SNIPPET, ANALYZED = 6, 12, 3, 320, 0.12
MODES = ("standard", "expanded", "complete")


def snippet(text: Column, size: int = SNIPPET) -> Column:
    """The first characters of a text, lines kept, without white space at line ends and empty lines around."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"[ \t]+(\n|\z)", "$1")
    return F.regexp_replace(F.substring(F.regexp_replace(lines, r"\A\n+", ""), 1, size), r"[ \t\n]+\z", "")


def memories(queries: DataFrame, turns: DataFrame, k: int = MEMORIES) -> DataFrame:
    """(item_id, conv_id, turn, shared, rank): the ``k`` user turns that share most terms with each question, ties by place."""
    asked = queries.select("item_id", F.explode(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("term"))
    held = turns.where("role = 'user'").select("conv_id", "turn", F.explode(F.array_distinct(T.keyword_tokens(F.col("text")))).alias("term"))
    shared = held.join(asked, "term").groupBy("item_id", "conv_id", "turn").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("shared"), "conv_id", "turn"))
    return shared.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def source_packets(queries: DataFrame, docs: DataFrame, scores: DataFrame) -> DataFrame:
    """(item_id, source, doc_id, score, status, rank) of every source for each question; without a hit the document is null."""
    hits = scores.join(docs.select("doc_id", "source"), "doc_id")
    best = hits.groupBy("item_id", "source").agg(F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id"), F.max("score").alias("score"))
    every = queries.select("item_id").join(docs.select("source").distinct())  # a stated query set against all sources
    got = every.alias("e").join(best.alias("b"), (F.col("e.item_id") == F.col("b.item_id")) & F.col("e.source").eqNullSafe(F.col("b.source")), "left")
    got = got.select("e.item_id", "e.source", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "source"))
    return got.withColumn("status", F.when(F.col("score") >= ANALYZED, "analyzed").otherwise("low_relevance")).withColumn("rank", rank.cast("long"))


def bundles(queries: DataFrame, docs: DataFrame, turns: DataFrame, budget: int) -> DataFrame:
    """(item_id, mode, place, stream, handle, score, cost, taken) of every candidate, in all modes.

    ``docs``: doc_id, source, lang (the cluster), text; ``turns``: conv_id, turn, role, text.
    """
    scores = settled(lexical.bm25_scores(docs, queries))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")).cast("long")
    best = scores.withColumn("rank", rank).where(F.col("rank") <= EVIDENCE).withColumn("source", F.lit(None).cast("string"))
    packets = settled(source_packets(queries, docs, scores))
    parts = ["item_id", "mode", "rank", "doc_id", "source", "score"]
    chosen = best.withColumn("mode", F.lit("standard")).select(parts)
    chosen = chosen.unionByName(packets.where((F.col("rank") <= SOURCES) & F.col("doc_id").isNotNull()).withColumn("mode", F.lit("expanded")).select(parts))
    chosen = settled(chosen.unionByName(packets.withColumn("mode", F.lit("complete")).select(parts)))
    said = docs.select("doc_id", "lang", T.token_estimate(snippet(F.col("text"))).alias("cost"))
    found = settled(chosen.join(said, "doc_id", "left"))
    handle = F.when(F.col("doc_id").isNotNull(), F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))))
    evidence = found.select("item_id", "mode", F.lit("evidence").alias("stream"), "rank", handle.alias("handle"), "score", F.coalesce("cost", F.lit(1)).cast("long").alias("cost"))
    held = memories(queries, turns).join(turns.where("role = 'user'").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    memory = held.select("item_id", F.explode(F.array(*map(F.lit, MODES))).alias("mode"), F.lit("memory").alias("stream"), "rank", F.concat(F.lit("memory:"), F.concat_ws("-", "conv_id", "turn")).alias("handle"), F.col("shared").cast("double").alias("score"), T.token_estimate(F.col("text")).cast("long").alias("cost"))
    groups = found.where("lang is not null").groupBy("item_id", "mode", "lang").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("item_id", "mode").orderBy(F.desc("score"), "lang")).cast("long")
    cluster = groups.select("item_id", "mode", F.lit("cluster").alias("stream"), nth.alias("rank"), F.concat(F.lit("cluster:"), "lang").alias("handle"), "score", F.lit(4).cast("long").alias("cost"))
    rows = evidence.unionByName(memory).unionByName(cluster)
    order = F.array_position(F.array(*map(F.lit, ("evidence", "memory", "cluster"))), F.col("stream"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("item_id", "mode").orderBy(order, "rank", "handle")).cast("long"))
    keyed = rows.withColumn("bundle", F.concat_ws(" ", F.col("item_id").cast("string"), "mode"))
    return pack(keyed, "bundle", "place", "cost", budget, first_always=True).select("item_id", "mode", "place", "stream", "handle", "score", "cost", "taken")
