"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents form a stream in a random order, repeated as often as
its target needs and cut there to the word.  The stream is cut into blocks.
The exact numbers of blocks of all sources are split among the output shards
by a tree: each node sends half of its shards a multivariate hypergeometric
draw of its quotas, down to single shards.  Each source's blocks, permuted,
then go to the shards by those quotas, and every shard shuffles its pieces by
a hash: shard and place of every piece are columns of the result, and the mix
as documents is written shard by shard in that order.  Documents are placed in
their stream by two sums, one over parts of a source and one inside a part,
whose number grows with the rows, so that no task holds a whole source.

Only DataFrame functions run over rows; the driver holds one line per source,
of about 1 kB up to 1,024 sources and of 0.1 kB or more beyond.

Defined results: null, empty and wordless texts have size 0 and are never
taken; a null source is a source of its own, last in order; repeated rows are
separate documents; an empty table gives no rows; result columns replace input
columns of their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, literal_table, without

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL, MOST = 1.5, 2.0
#: Rows of each part of a source's stream that is summed apart, about, if it held all rows.
ROWS_OF_PART = 512
#: Words of a block at least; blocks of a source at most, and of all sources together, about.
BLOCK_WORDS, MAX_BLOCKS, ALL_BLOCKS = 256, 256, 1 << 18
#: Slices of a shard, by place, that are put in order apart from each other, as a power of two.
SLICE_BITS = 6
#: Sources up to which their table (about 1 kB each) is broadcast; with more it is joined by shuffle.
BROADCAST_SOURCES = 4096


def words_in(text) -> F.Column:
    """Number of runs of characters other than the six ASCII spaces; null: 0."""
    flat = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\u000b\u000c\r", "     ")
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def targets(sizes: dict[str | None, int], weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give: shares by weight, stopped at ``most`` times its size, the excess reshared."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = total * sum(sizes.values()), list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > most * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def splitting_tree(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: the quotas (blocks of each source) split exactly and, in total, evenly among the shards."""
    out = np.zeros((n_shards, len(quotas)), np.int64)
    todo = [(0, n_shards, np.asarray(quotas, np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        need = total * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, need, method="marginals") if total else have
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def mix(docs: DataFrame, n_shards: int = 16, seed: int = 7, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``docs`` with size, source_size, target, taken and pieces: what each output shard takes of the document.

    ``pieces``: array of (shard, block, epoch, from_word, n_words, place), block
    being its number in the source's stream; a shard's pieces are read in order
    of ``place``.
    """
    new = ("size", "source_size", "target", "taken", "pieces")
    n_parts = max(1, -(-docs.count() // ROWS_OF_PART))
    source = F.col("source").cast("string")
    base = docs.select(*without(docs, *new), words_in(F.col("text")).alias("size"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("v"), source)).alias("__ql_source"))
    base = base.withColumn("__ql_h", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("__ql_part", F.pmod("__ql_h", F.lit(n_parts)))
    parts = checkpointed(base.groupBy("__ql_source", "__ql_part").agg(F.sum("size").alias("words")))
    sizes = {None if r[0] == "n" else r[0][1:]: int(r[1]) for r in parts.groupBy("__ql_source").agg(F.sum("words")).collect()}
    aim = targets(sizes, weights, total, most)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    rng = np.random.default_rng(seed)
    words = [min(int(aim[s] + 0.5), int(most * sizes[s])) for s in order]
    most_blocks = min(MAX_BLOCKS, max(n_shards, ALL_BLOCKS // max(1, len(order))))
    block = [max(BLOCK_WORDS, -(-w // most_blocks)) for w in words]
    quotas = np.array([-(-w // b) for w, b in zip(words, block)], np.int64)
    tree = splitting_tree(quotas, n_shards, rng) if len(order) else np.zeros((n_shards, 0), np.int64)
    rows = []
    for i, s in enumerate(order):
        home = np.empty(quotas[i], np.int64)
        home[rng.permutation(quotas[i])] = np.repeat(np.arange(n_shards), tree[:, i])
        rows.append({"k": "n" if s is None else f"v{s}", "source_size": sizes[s], "target": aim[s], "aim": words[i], "block": block[i], "home": home.tolist()})
    sources = literal_table(docs.sparkSession, rows, "k:string,source_size:bigint,target:double,aim:bigint,block:bigint,home:array<int>")
    if len(rows) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    before = Window.partitionBy("__ql_source").orderBy("__ql_part").rowsBetween(Window.unboundedPreceding, -1)
    above = parts.select("__ql_source", "__ql_part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("__ql_above"))
    inside = Window.partitionBy("__ql_source", "__ql_part").orderBy("__ql_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.withColumn("__ql_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(above, ["__ql_source", "__ql_part"]).join(sources, F.col("__ql_source") == F.col("k"))
    start = F.col("__ql_above") + F.col("__ql_in")
    placed = placed.withColumn("__ql_start", start)
    # runs of the stream: (epoch, first word, end) as far as the target reaches
    runs = F.transform(
        F.sequence(F.lit(0), F.lit(int(np.ceil(most)))),
        lambda e: F.struct(e.alias("e"), (e * F.col("source_size") + F.col("__ql_start")).alias("a"), F.least(e * F.col("source_size") + F.col("__ql_start") + F.col("size"), F.col("aim")).alias("z")),
    )
    runs = F.filter(runs, lambda r: r["z"] > r["a"])

    def cut(r):
        b = F.col("block")
        return F.transform(
            F.sequence(F.floor(r["a"] / b), F.floor((r["z"] - 1) / b)),
            lambda k: F.struct(
                F.element_at("home", (k + 1).cast("int")).alias("shard"),
                k.cast("long").alias("block"),
                r["e"].cast("int").alias("epoch"),
                (F.greatest(r["a"], k * b) - r["a"]).alias("from_word"),
                (F.least(r["z"], (k + 1) * b) - F.greatest(r["a"], k * b)).alias("n_words"),
                F.xxhash64(F.lit(seed + 1), "doc_id", r["e"], k).alias("place"),
            ),
        )

    placed = placed.withColumn("pieces", F.flatten(F.transform(runs, cut)))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["n_words"])
    return placed.select(*without(docs, *new), "size", "source_size", "target", taken.alias("taken"), "pieces")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of ``docs``, in order of shard and place: a document once for each epoch in which it is taken.

    A document stands whole where its first piece of that epoch goes, also where
    the target cuts its last words off.
    """
    first = F.filter("pieces", lambda p: p["from_word"] == 0)  # one of each epoch
    got = mix(docs, **how).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(first).alias("__ql_piece"))
    slices = F.shiftrightunsigned("__ql_piece.place", 64 - SLICE_BITS)
    return got.repartition("__ql_piece.shard", slices).sortWithinPartitions("__ql_piece.shard", "__ql_piece.place").select(docs.columns)
