"""Exact containment of a query set's texts in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANCHOR_WORDS = 4
#: Short texts that are compared with all documents at once.
SHORT_ITEMS = 10_000


def first_containing(docs: DataFrame, items: DataFrame, short_items: int = SHORT_ITEMS) -> DataFrame:
    """(item_id, gold): the smallest doc_id whose text contains the item's text.

    Documents and items meet on the hash of four consecutive words inside the
    item (its second to fifth, which stand whole in any document that contains
    the text); only such pairs are compared.  Items of fewer than six words
    have no such four: they are compared with every document, in blocks of
    about ``short_items`` distinct texts.  The empty text stands in every document.
    """
    words = F.split(F.col("text"), "[ \\t\\n\\r]+")
    split = items.where("text is not null").select("item_id", F.col("text").alias("needle"), words.alias("w"))
    long = F.size("w") > ANCHOR_WORDS + 1
    keyed = split.where(long).select("item_id", "needle", F.xxhash64(F.array_join(F.slice("w", 2, ANCHOR_WORDS), " ")).alias("h"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR_WORDS + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, ANCHOR_WORDS), " ")))
    places = docs.select("doc_id", words.alias("w")).where(F.size("w") >= ANCHOR_WORDS).select("doc_id", F.explode(F.array_distinct(grams)).alias("h"))
    near = places.join(keyed, "h").select("item_id", "needle", "doc_id")
    found = near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "needle"))
    out = found.groupBy("item_id").agg(F.min("doc_id").alias("gold"))
    short = split.where(~long).select("item_id", "needle")
    texts = short.select("needle").distinct()
    n = texts.count()
    n_blocks = -(-n // short_items)
    for k in range(n_blocks):
        block = F.broadcast(texts.where(F.pmod(F.xxhash64("needle"), F.lit(n_blocks)) == k))  # a part of the query set
        hit = docs.select("doc_id", "text").join(block, F.contains("text", "needle")).groupBy("needle").agg(F.min("doc_id").alias("gold"))
        out = out.unionByName(short.join(hit, "needle").groupBy("item_id").agg(F.min("gold").alias("gold")))
    return out.groupBy("item_id").agg(F.min("gold").alias("gold")) if n_blocks else out
