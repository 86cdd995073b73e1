"""N-gram Jaccard join by filters under several global token orders.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is at least 0.8.  Under *any* global order of the tokens, two such
sets share a token of their prefixes (the first ``n - ceil(0.8 n) + 1``
tokens).  The join uses three orders and keeps a candidate only if it passes
under every one of them:

* order R, rarest first.  How common a token is comes from a counting table
  over all documents, with a fixed number of cells: a fixed size to broadcast
  whatever the input.  Passages that many documents share stand last in this
  order, so they are in few prefixes.  A cell of a larger input holds more
  other tokens, but their number varies only by its square root, so tokens
  far above that stay last.
* orders B and C, two independent pseudo-random orders, which intersect the
  candidates of order R before any set is moved: of the tokens that two sets
  have up to the end of the shorter prefix so many have to be shared that
  the rest can still add up to a link.

Texts are read four times: for the counts, for the summaries (prefixes under
all orders, kept without the text), and for the sets of the candidates that
passed all orders, of the stars and of the join.

Sets equal as a whole form a class first, and only its representative joins,
so copies are never expanded into pairs.  Near copies are contracted before
the join, too: representatives that share the first token under one of three
random orders are compared with one leader of that group (a star, not all
pairs; the leader is looked up by parts of the group); the exact join then
looks only at pairs that are not yet in one component.  A token that more than PART_ROWS prefixes share is joined in
parts, so that no task holds all of them.  Every kept candidate is verified
with the exact 64-bit shingle sets.

Defined results: null and empty texts have an empty set and are linked with
nothing; texts of one to four words are one shingle; repeated rows of one
doc_id are one document; a null doc_id is a document with a null component
and no links; ties between equal documents go to the smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed
from .graph import components

#: Cells of the table that says how common a token is, as a power of two; cells of one of its rows.
CELL_BITS, CHUNK_BITS = 20, 12
#: Random orders used for the stars, and for orders B and C.
STAR_SEEDS = (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1)
B_SEED, C_SEED = 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1
#: Bits of the table that says which documents are candidates: 16 for each, from 2**16 to 2**30 (128 MB).
ID_BITS, LEAST_BITS, MOST_BITS = 16, 16, 30
#: A token in this many documents or more may be in too many prefixes for one task; prefixes of one token joined at once; parts of a star.
HOT_COUNT, PART_ROWS, STAR_PARTS = 4096, 2048, 64
#: Common tokens up to which their parts are broadcast, 12 bytes each.
BROADCAST_TOKENS = 500_000


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row of a batch."""
    buf, offs = tc.buffers(batch.column("text"))
    for a, b in tc.pieces(offs):
        words, first = tc.word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], "space")
        for k, x in enumerate(tc.shingles(words, first)):
            yield a + k, np.unique(x)


def token_counts(docs: DataFrame) -> np.ndarray:
    """How many documents have a token of each cell, over all documents; always 2**CELL_BITS numbers."""

    def count(batches):
        table = np.zeros(1 << CELL_BITS, np.int64)
        for batch in tc.small(batches):
            for _, u in _sets(batch):
                np.add.at(table, (u >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        if table.any():
            parts = table.reshape(-1, 1 << CHUNK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "cells"])

    def add(key, t):
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for x in t.column("cells").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()], pa.binary())})

    each = docs.select("text").mapInArrow(count, "chunk int, cells binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = each.groupBy("chunk", "part").applyInArrow(add, "chunk int, cells binary")
    rows = some.groupBy("chunk").applyInArrow(add, "chunk int, cells binary").collect()
    out = np.zeros((1 << CELL_BITS >> CHUNK_BITS, 1 << CHUNK_BITS), np.int64)
    for r in rows:
        out[r["chunk"]] = np.frombuffer(r["cells"], np.int64)
    return out.reshape(-1)


def _order_r(u: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``u`` from the rarest token on; ties by the token."""
    common = np.minimum(counts[(u >> np.uint64(64 - CELL_BITS)).astype(np.int64)], (1 << 31) - 1).astype(np.uint64)
    return u[np.argsort((common << np.uint64(32)) | (u & np.uint64(0xFFFFFFFF)), kind="stable")]


def _prefix_random(u: np.ndarray, seed: int) -> np.ndarray:
    """The prefix of ``u`` under a random order, each token as the upper 16 bits of its place, in order (tokens that share them only weaken the test)."""
    v = tc.mix(u ^ np.uint64(seed))
    p = prefix_length(len(v))
    return np.sort((np.partition(v, p - 1)[:p] if p < len(v) else v) >> np.uint64(48)).astype(np.uint16)


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int) -> bool:
    """Whether sets of n and m tokens with prefixes ``x`` and ``y`` under one order can share the ``4 (n + m) / 9`` tokens of a link.

    All tokens before the end of the shorter prefix are known of both sets; of
    the others at most all can be shared.
    """
    end = min(x[-1], y[-1])
    a, b = x[: np.searchsorted(x, end)], y[: np.searchsorted(y, end)]
    shared = int(np.isin(a, b, kind="sort").sum()) if len(a) and len(b) else 0
    return 9 * (shared + min(n - len(a), m - len(b))) >= 4 * (n + m)


SUMMARY = "doc_id long, n_shingles long, set_key binary, stars array<long>, prefix array<long>, n_cold int, b binary, c binary"


def summaries(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), stars (first token under each star order), prefix (order R; of ``n_cold`` tokens not too common), b, c (prefixes under these orders)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts.astype(np.int64))

    def each(batches):
        cells = shared.value
        for batch in tc.small(batches, 256):
            columns = [[] for _ in range(7)]
            for _, u in _sets(batch):
                n = len(u)
                if not n:
                    for k, c in enumerate(columns):
                        c.append(None if k else 0)
                    continue
                stars = np.array([tc.mix(u ^ np.uint64(s)).min() for s in STAR_SEEDS])
                prefix = _order_r(u, cells)[: prefix_length(n)]
                cold = int((cells[(prefix >> np.uint64(64 - CELL_BITS)).astype(np.int64)] < HOT_COUNT).sum())  # the common ones stand last
                key = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
                for c, x in zip(columns, (n, key, stars.astype(np.int64), prefix.astype(np.int64), cold, _prefix_random(u, B_SEED).tobytes(), _prefix_random(u, C_SEED).tobytes())):
                    c.append(x)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary())
            names = ["doc_id", "n_shingles", "set_key", "stars", "prefix", "n_cold", "b", "c"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, SUMMARY)


def _id_bits(pairs: DataFrame) -> np.ndarray:
    """Bit table of the ids at both ends; of a bounded size, it may let others pass but never stops one of them."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (ID_BITS * 2 * pairs.count()).bit_length()))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(F.pmod(F.xxhash64("id"), F.lit(size)).alias("h"))
    words = ids.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()  # at most size / 64 rows
    out = np.zeros(size >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint64)


def _of_pairs(rows: DataFrame, pairs: DataFrame, schema: str, each) -> DataFrame:
    """``each`` (batch to arrays) of the rows that may stand at an end of the pairs, as (id, ...) by ``schema``."""
    table = _id_bits(pairs)
    bits, size = rows.sparkSession.sparkContext.broadcast(table), len(table) << 6
    names = ["id", *(x.split()[0] for x in schema.split(", "))]

    def pick(batches):
        table = bits.value
        for batch in tc.small(batches):
            at = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
            keep = pa.array((table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
            batch = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *each(batch)], names=names)

    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(size)).alias("slot")
    known = rows.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long")).select("*", slot)
    return known.mapInArrow(pick, f"id long, {schema}")


def _at_both_ends(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The pairs with the columns of ``values`` (id, ...) of both ends, named by the end behind the name."""
    for end in ("b", "a"):
        pairs = pairs.join(values.select(*(F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in values.columns)), end)
    return pairs


def verify(docs: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of doc_ids those whose sets pass orders B and C (from ``rows``, the summaries) and then have Jaccard similarity of at least 0.8."""

    def pass_orders(batches):
        for batch in tc.small(batches, 256):
            got = [batch.column(c).to_pylist() for c in ("n_a", "n_b", "b_a", "b_b", "c_a", "c_b")]
            keep = [
                5 * min(n, m) >= 4 * max(n, m) and all(may_link(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, m) for x, y in ((b1, b2), (c1, c2)))
                for n, m, b1, b2, c1, c2 in zip(*got)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches):
        for batch in tc.small(batches, 256):
            keep = []
            for x, y in zip(batch.column("t_a").to_pylist(), batch.column("t_b").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= 80 * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    prefixes = rows.where("n_shingles > 0").select("doc_id", "n_shingles", "b", "c")
    marks = _of_pairs(prefixes, pairs, "n long, b binary, c binary", lambda batch: [batch.column(c) for c in ("n_shingles", "b", "c")])
    passed = _at_both_ends(pairs, marks.select("id", "n", "b", "c"))
    passed = checkpointed(passed.select("a", "b", *(f"{c}_{end}" for c in "nbc" for end in "ab")).mapInArrow(pass_orders, "a long, b long").distinct())
    sets = _of_pairs(docs.select("doc_id", F.col("text").cast("string")), passed, "t binary", lambda batch: [pa.array([u.tobytes() for _, u in _sets(batch)], pa.binary())])
    return _at_both_ends(passed, sets).select("a", "b", "t_a", "t_b").mapInArrow(check, "a long, b long").distinct()


def star_pairs(reps: DataFrame) -> DataFrame:
    """Representatives (rep, stars) with the same first token under a star order, each with the smallest of its group, which parts of the group look up."""
    each = reps.select("rep", F.pmod(F.xxhash64("rep"), F.lit(STAR_PARTS)).alias("part"), F.posexplode("stars").alias("k", "token"))
    parts = each.groupBy("k", "token", "part").agg(F.min("rep").alias("low"), F.count("*").alias("c"))
    group = Window.partitionBy("k", "token")  # at most STAR_PARTS rows
    lead = parts.withColumns({"a": F.min("low").over(group), "c": F.sum("c").over(group)}).where("c > 1").select("k", "token", "part", "a")
    return each.join(lead, ["k", "token", "part"]).where(F.col("rep") > F.col("a")).select("a", F.col("rep").alias("b")).distinct()


def common_tokens(known: DataFrame, grp: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(token, parts) of the tokens behind the first ``n_cold`` of a prefix (set_key, prefix, n_cold): parts of about ``part_rows`` prefixes; 0 if only one group (set_key, grp) has the token."""
    tail = known.where(F.size("prefix") > F.col("n_cold")).select("set_key", F.slice("prefix", F.col("n_cold") + 1, 1 << 30).alias("tail"))
    each = tail.groupBy("set_key").agg(F.first("tail").alias("tail")).join(grp, "set_key").select("grp", F.explode("tail").alias("token"))
    many = each.groupBy("token").agg(F.count("*").alias("c"), F.min("grp").alias("low"), F.max("grp").alias("high"))
    return many.select("token", F.when(F.col("low") == F.col("high"), 0).otherwise(F.ceil(F.col("c") / part_rows)).cast("int").alias("parts"))


def prefix_pairs(reps: DataFrame, common: DataFrame) -> DataFrame:
    """Representatives (rep, grp, n, prefix) of different groups that share a prefix token under order R.

    Of two sets of n <= m tokens, the needed overlap is ``ceil(4 (n + m) / 9)``;
    a match at positions i, j can be the pair's first match only if so many
    tokens can still be shared, which every link's first match fulfils.

    A token in ``common`` (token, parts) is left out if only one group has it,
    and joined in parts otherwise: each part with itself and with each other.
    """
    each = reps.select("rep", "grp", "n", F.posexplode("prefix").alias("pos", "token"))
    rows = each.join(common, "token", "left").where("parts is null or parts > 0")
    mine = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    split = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")))
    rows = rows.withColumn("part", F.explode(F.when(F.col("parts") > 1, split).otherwise(alone)))
    keys = ["token", "i", "j"]
    # a group of one is its representative; size and place travel as one number
    rows = rows.select("token", "part.*", "rep", F.when(F.col("grp") != F.col("rep"), F.col("grp")).alias("grp"), (F.shiftleft("n", 32) + F.col("pos")).alias("np"))
    x, y = (rows.select(*keys, *(F.col(c).alias(f"{c}_{end}") for c in ("rep", "grp", "np"))) for end in "ab")
    both = x.join(y, keys).where(F.col("rep_a") < F.col("rep_b")).where(F.coalesce("grp_a", "rep_a") != F.coalesce("grp_b", "rep_b"))
    n_a, n_b = (F.shiftright(f"np_{end}", 32) for end in "ab")
    pos_a, pos_b = (F.col(f"np_{end}").bitwiseAND(0xFFFFFFFF) for end in "ab")
    near = (n_a * 5 >= n_b * 4) & (n_b * 5 >= n_a * 4) & (F.least(n_a - pos_a, n_b - pos_b) * 9 >= (n_a + n_b) * 4)
    return both.where(near).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; see the module's text for odd inputs."""
    rows = checkpointed(summaries(docs, token_counts(docs)))
    member = rows.select("doc_id", "n_shingles", "set_key")
    known = rows.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    first = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"))

    def reps(*columns: str) -> DataFrame:
        return known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in columns)).drop("set_key")

    star_links = checkpointed(verify(docs, rows, checkpointed(star_pairs(reps("stars")))))
    groups = components(star_links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    # groups go by the key of the set, as which the prefixes are grouped already
    grp = first.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("grp"))
    grouped = known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix")).join(grp, "set_key")
    common = checkpointed(common_tokens(known, grp))
    if common.count() <= BROADCAST_TOKENS:
        common = F.broadcast(common)
    links = verify(docs, rows, checkpointed(prefix_pairs(grouped, common)))
    edges = links.unionByName(star_links)
    found = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    classes = first.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    return member.join(classes, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id, and its first row.

    Rows with a null doc_id stay.
    """
    found = jaccard_components(docs)
    keep = checkpointed(found.where((F.col("doc_id") == F.col("component_id")) | F.col("doc_id").isNull()).select("doc_id").distinct())
    kept = docs.join(keep.where("doc_id is not null"), "doc_id", "left_semi").select(docs.columns)
    one = Window.partitionBy("doc_id").orderBy(*(F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map")))
    kept = kept.withColumn("__ql_row", F.row_number().over(one)).where("__ql_row = 1").drop("__ql_row")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
