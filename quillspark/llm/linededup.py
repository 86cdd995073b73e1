"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines is hashed (two independent 64-bit
hashes).  The first occurrence of a window over all documents, by doc_id and
line, stays; the lines that any other occurrence covers are removed, overlaps
merged.  The first occurrences are a grouped minimum, combined before its
shuffle, so a window that every document has is one row of each task; they go
back to their documents as line numbers, and what a document holds besides is
a later occurrence.  No join is made on windows, and the text moves once.

Defined results: null texts stay null; texts of fewer than three lines, empty
ones included, have no window and stay as they are; rows equal in doc_id (null
included) and text are one document at one place; of rows of one doc_id with
different texts the one with the smaller hash is the earlier; all other
columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without

LINES = 3


def first_windows(docs: DataFrame) -> DataFrame:
    """(first): doc_id, row (hash of the text) and pos of the first occurrence of every window."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.xxhash64(text).alias("row"), F.split(text, "\n").alias("l")).where(F.size("l") >= LINES)
    windows = F.transform(F.sequence(F.lit(1), F.size("l") - LINES + 1), lambda i: F.concat_ws("\n", F.slice("l", i, LINES)))
    rows = rows.select("doc_id", "row", F.posexplode(windows).alias("pos", "w"))
    place = F.struct("doc_id", "row", "pos")
    return rows.groupBy(F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2")).agg(F.min(place).alias("first")).select("first")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text cleaned, and n_lines, n_removed (null text: null)."""
    own = first_windows(docs).groupBy(F.col("first.doc_id").alias("__ql_id"), F.col("first.row").alias("__ql_row")).agg(F.collect_list("first.pos").alias("__ql_own"))
    text = F.col("text").cast("string")
    joined = docs.join(own, F.col("doc_id").eqNullSafe(F.col("__ql_id")) & (F.xxhash64(text) == F.col("__ql_row")), "left").withColumn("__ql_l", F.split(text, "\n"))
    none = F.array().cast("array<int>")
    windows = F.when(F.size("__ql_l") >= LINES, F.sequence(F.lit(0), F.size("__ql_l") - LINES)).otherwise(none)
    joined = joined.withColumn("__ql_cut", F.array_except(windows, F.coalesce("__ql_own", none)))  # hash sets: linear in the lines
    joined = joined.withColumn("__ql_cov", F.array_distinct(F.flatten(F.transform("__ql_cut", lambda p: F.array(*(p + k for k in range(LINES)))))))
    left = F.array_except(F.sequence(F.lit(0), F.size("__ql_l") - 1), F.col("__ql_cov"))
    kept = F.concat_ws("\n", F.transform(left, lambda i: F.element_at("__ql_l", i + 1)))
    return joined.select(
        *without(docs, "text", "n_lines", "n_removed"),
        F.when(text.isNotNull(), F.when(F.size("__ql_cov") == 0, text).otherwise(kept)).alias("text"),
        F.when(text.isNotNull(), F.size("__ql_l").cast("long")).alias("n_lines"),
        F.when(text.isNotNull(), F.size("__ql_cov").cast("long")).alias("n_removed"),
    )
