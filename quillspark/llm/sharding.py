"""Uniform sharding by a hypergeometric communication matrix.

The rows are dealt to blocks by a hash.  Of the block sizes and the exact
shard sizes (at most one row apart) the driver draws a communication matrix:
row by row a multivariate hypergeometric draw says how many rows each block
sends to each shard.  Inside its block a row's random rank then fixes its
shard, and inside its shard a second random order fixes its slot.  Every
permutation is a sort within a block or within a small part of a shard, so no
task ever holds a shard, and every draw comes from the seed, so a lost
executor's rows come out the same again.

Law ``rows``: counts of shards at most one apart.  Defined results: null texts
have size 16 and checksum 0; rows that are equal in doc_id and text are
exchangeable; an empty table gives no rows; result columns replace input
columns of their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import literal_table, without

#: Rows of a block, about; no more than MAX_BLOCKS blocks, whatever the input.
ROWS_OF_BLOCK, MAX_BLOCKS = 4096, 1 << 15
#: Parts of a shard that are put in order apart from each other.
PARTS = 64


def communication_matrix(blocks: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard: blocks x shards, drawn uniformly."""
    total = sum(blocks)
    left = np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), n_shards), np.int64)
    for i, n in enumerate(blocks):
        remaining, need = int(left.sum()), int(n)
        for s in range(n_shards):  # the marginals one by one
            if need == 0:
                break
            remaining -= int(left[s])
            out[i, s] = _draw(rng, int(left[s]), remaining, need)
            need -= int(out[i, s])
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; numpy's is defined below 10**9, beyond which the distribution function is inverted."""
    if n == 0 or good == 0:
        return 0
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return int(_inverse(good, bad, n, rng.random()))


def _inverse(good: int, bad: int, n: int, u: float) -> int:
    """Where the hypergeometric distribution function passes ``u``.

    The terms are summed from their ratios around the mode, out to 12 standard
    deviations; all others together are below the precision of a double.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    reach = 12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1))) + 40
    low, high = max(0, n - bad, int(mode - reach)), min(n, good, int(mode + reach))
    k = np.arange(low, high, dtype=np.float64)
    log = np.concatenate([[0.0], np.cumsum(np.log((good - k) / (k + 1) * (n - k) / (bad - n + k + 1)))])
    mass = np.cumsum(np.exp(log - log.max()))
    return low + min(int(np.searchsorted(mass, u * mass[-1], "right")), high - low)


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 20) -> DataFrame:
    """``docs`` with size (UTF-8 bytes + 16), text_crc32, law, shard, slot and grown_shard (null under this law)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = docs.select(*without(docs, "size", "text_crc32", "law", "shard", "slot", "grown_shard"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    n = docs.count()
    n_blocks = max(1, min(MAX_BLOCKS, -(-n // ROWS_OF_BLOCK)))
    keyed = base.select("*", *(F.xxhash64(F.lit(seed + k), "doc_id", "text_crc32", "size").alias(f"__ql_h{k}") for k in (0, 1, 2)))
    keyed = keyed.withColumn("__ql_block", F.pmod("__ql_h0", F.lit(n_blocks)).cast("int"))
    sizes = {r[0]: r[1] for r in keyed.groupBy("__ql_block").count().collect()}  # at most MAX_BLOCKS rows
    names = sorted(sizes)
    matrix = communication_matrix([sizes[b] for b in names], n_shards, seed)
    cells = literal_table(docs.sparkSession, [{"b": b, "upto": np.cumsum(matrix[i]).tolist()} for i, b in enumerate(names)], "b:int,upto:array<bigint>")
    rank = F.row_number().over(Window.partitionBy("__ql_block").orderBy("__ql_h1", "doc_id", "text_crc32", "size"))

    def dealt(rows: DataFrame) -> DataFrame:
        ranked = rows.withColumn("__ql_rank", rank).join(F.broadcast(cells), F.col("__ql_block") == F.col("b"))
        return ranked.withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("__ql_rank"))).cast("int")).withColumn("__ql_part", F.pmod("__ql_h2", F.lit(PARTS)).cast("int"))

    thin = dealt(keyed.select("doc_id", "text_crc32", "size", "__ql_h1", "__ql_h2", "__ql_block"))
    counts = thin.groupBy("shard", "__ql_part").count().collect()  # shards x PARTS rows
    above, rows = dict.fromkeys(range(n_shards), 0), []
    for r in sorted(counts):
        rows.append({"s": r[0], "p": r[1], "above": above[r[0]]})
        above[r[0]] += r[2]
    bases = literal_table(docs.sparkSession, rows, "s:int,p:int,above:bigint")
    inside = F.row_number().over(Window.partitionBy("shard", "__ql_part").orderBy("__ql_h2", "doc_id", "text_crc32", "size"))
    out = dealt(keyed).withColumn("__ql_in", inside).join(F.broadcast(bases), (F.col("shard") == F.col("s")) & (F.col("__ql_part") == F.col("p")))
    return out.select(
        *without(base, "size", "text_crc32"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("above") + F.col("__ql_in") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
