"""Hard negatives by rotated one-bit codes with stored alignment.

Vectors of whole numbers are turned by random signs and a Hadamard transform
(exact in whole numbers) and coded by the signs of what comes out; beside a
code stands its alignment, the mean size of a component, which is the
vector's share along the code.  What a code leaves over is coded the same way
``LEVELS`` times.  The inner product of a code with an anchor is put together
from popcounts of the code and the anchor's bit planes.  Where a code's part
is known, what is left over is at right angles to it, so by Cauchy and Schwarz
its product with the anchor is at most its length times that of the anchor's
part off the code: an interval that holds the score for certain.  One code in
64 dimensions leaves three fifths of a vector's length and rules out little;
each further code leaves three to four fifths of that.

A row stays a candidate while its interval can still reach the best found so
far (positives), or the band below a positive (negatives).  The rows that
stay are scored in whole numbers, so results are exact.

Anchors are a stated query set against all rows: blocks of anchors meet blocks
of rows, and only the best few of an anchor leave a task.  Codes are made once
and written to the checkpoint folder; nothing is broadcast or collected.

Defined results: rows without an id, a label or a vector, or with a component
that is null or not finite, take no part; shorter vectors are filled up with
zeros; "other" rows have another id; of one anchor's rows with the same score
and id one counts; an id with several rows is several anchors; scores beyond a
long stop at its ends; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Codes of a vector; rows of a block; anchors of a block.
LEVELS, BLOCK, ANCHORS = 5, 8192, 1024
#: Components become floor(SCALE * x).
SCALE = 256
SEED = 29
#: No interval is tried while codes leave over more than this share of the squared length.
LOOSE = 0.1
BIG = 2**63 - 1


BLOCKS = "ids binary, labels binary, whole binary, codes binary, aligned binary, squares binary"
ANCHOR_BLOCKS = "q_ids binary, q_keys binary, q_labels binary, q_whole binary, q_positives binary"


def taking_part(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, key, v) of the rows that take part; ``key`` tells rows of one id apart."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    finite = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite).withColumn("key", F.xxhash64("label", "v"))


def padded(rows: list[list[float]], size: int) -> np.ndarray:
    """floor(SCALE * x) of each component, rows filled up with zeros; whole numbers beyond 2**53 stay what the double says."""
    out = np.zeros((len(rows), size))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return np.floor(out * SCALE)


def rotated(m: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows with random signs, then a Hadamard transform: inner products grow by the number of columns, a power of two."""
    n = m.shape[1]
    out = m * (np.random.default_rng(seed).integers(0, 2, n) * 2 - 1)
    h = 1
    while h < n:
        pairs = out.reshape(len(m), -1, 2, h)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(m), n)
        h *= 2
    return out


def coded(m: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (levels x rows x words), alignments and the squared lengths left over (levels x rows) of rotated rows."""
    left, n = m.astype(np.float64), m.shape[1]
    codes, aligned, squares = [], [], []
    for _ in range(levels):
        up = left >= 0
        a = np.abs(left).mean(1)
        left = left - np.where(up, a[:, None], -a[:, None])
        codes.append(np.packbits(up, axis=1, bitorder="little").view(np.uint64).reshape(len(m), n // 64))
        aligned.append(a)
        squares.append((left * left).sum(1))
    return np.stack(codes), np.stack(aligned), np.stack(squares)


class Anchor:
    """An anchor's bit planes, for products with codes by popcount."""

    def __init__(self, q: np.ndarray):
        self.n, self.low, self.total, self.square = len(q), int(q.min()), int(q.sum()), float((q * q).sum())
        above = (q - self.low).astype(np.uint64)
        width = max(1, int(above.max()).bit_length())
        self.planes = np.stack([np.packbits((above >> np.uint64(j)) & np.uint64(1) == 1, bitorder="little").view(np.uint64) for j in range(width)])
        self.weights = 2.0 ** np.arange(width)

    def product(self, codes: np.ndarray) -> np.ndarray:
        """The inner product with each row of signs that ``codes`` says."""
        shared, ones = np.bitwise_count(codes[None] & self.planes[:, None]), np.bitwise_count(codes)
        shared, ones = (shared[:, :, 0], ones[:, 0]) if codes.shape[1] == 1 else (shared.sum(2, dtype=np.int32), ones.sum(1, dtype=np.int32))
        return 2 * (self.weights @ shared + float(self.low) * ones) - self.total


class Block:
    """A block of rows with its codes."""

    def __init__(self, row: dict, size: int, levels: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        n = len(self.ids)
        self.whole = np.frombuffer(row["whole"], np.float64).reshape(n, size)
        self.codes = np.frombuffer(row["codes"], np.uint64).reshape(levels, n, -1)
        self.aligned, self.squares = (np.frombuffer(row[c], np.float64).reshape(levels, n) for c in ("aligned", "squares"))
        self.square = float((self.whole * self.whole).sum() / max(n, 1)) * size
        self.repeats = int(np.unique(self.ids, return_counts=True)[1].max()) if n else 1
        self.largest = float(np.abs(self.whole).max()) if n and size else 0.0

    def narrowed(self, anchor: Anchor, live: np.ndarray, keep) -> np.ndarray:
        """The rows of ``live`` that ``keep`` (low and high ends of their scores -> mask) lets through, code by code."""
        known = np.zeros(len(live))
        for codes, aligned, squares in zip(self.codes, self.aligned, self.squares):
            if not len(live):
                break
            along = anchor.product(codes[live])
            known += aligned[live] * along
            if float(squares.mean()) > LOOSE * self.square:
                continue
            off = np.sqrt(squares[live] * np.maximum(anchor.square - along * along / anchor.n, 0))
            slack = off * 1e-9 + np.abs(known) * 1e-9 + 1e-3 * anchor.n
            mask = keep((known - off - slack) / anchor.n, (known + off + slack) / anchor.n)
            live, known = live[mask], known[mask]
        return live

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products, stopped at the ends of a long."""
        if self.largest * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**53:
            return (self.whole[rows] @ q).astype(np.int64)
        ints = [int(x) for x in q]
        return np.array([max(-BIG - 1, min(BIG, sum(int(a) * b for a, b in zip(r, ints)))) for r in self.whole[rows]], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The first ``k`` different (score, id), higher scores first, ties by the smaller id."""
    order, out = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -BIG - 1 else -scores)), []
    for j in order:
        pair = (int(scores[j]), int(ids[j]))
        if not out or out[-1] != pair:
            if len(out) == k:
                break
            out.append(pair)
    return out


def _nth(values: np.ndarray, n: int) -> float:
    """The n-th largest value."""
    return np.partition(values, len(values) - n)[len(values) - n]


def positives_in(block: Block, anchor: Anchor | None, q: np.ndarray, own: int, label: int, k: int) -> list[tuple[int, int]]:
    live = np.flatnonzero((block.labels == label) & (block.ids != own))
    n = k * block.repeats
    if anchor is not None:
        live = block.narrowed(anchor, live, lambda low, high: high >= _nth(low, n) if len(low) > n else np.ones(len(low), bool))
    return best(block.scores(q, live), block.ids[live], k)


def band(positive: int, low: int, high: int) -> tuple[int, int]:
    """The scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def negatives_in(block: Block, anchor: Anchor | None, q: np.ndarray, label: int, bands: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each band the first ``k`` rows of another label in it."""
    live = np.flatnonzero(block.labels != label)
    n = k * block.repeats

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        any_ = (high >= min(a for a, _ in bands)) & (low <= max(b for _, b in bands))
        if not len(low) or (high - low).min() > max(b - a for a, b in bands):  # none can be sure to lie in a band
            return any_
        any_ = np.zeros(len(low), bool)
        for a, b in bands:
            may = (high >= a) & (low <= b)
            sure = low[(low >= a) & (high <= b)]
            any_ |= may & (high >= _nth(sure, n)) if len(sure) >= n else may
        return any_

    if anchor is not None:
        live = block.narrowed(anchor, live, keep)
    scores, ids = block.scores(q, live), block.ids[live]
    return [best(scores[m], ids[m], k) for m in ((scores >= a) & (scores <= b) for a, b in bands)]


def _size(vectors: DataFrame) -> int:
    """Columns of the rotated vectors: a power of two, 64 at least."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    return max(64, 1 << (longest - 1).bit_length() if longest else 64)


def index(rows: DataFrame, size: int, levels: int = LEVELS) -> DataFrame:
    """``rows`` in blocks with their codes."""

    def each(batches):
        for batch in batches:
            ids, labels, v = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), batch.column("v")
            for a in range(0, len(ids), BLOCK):
                m = padded(v.slice(a, BLOCK).to_pylist(), size)
                parts = (ids[a : a + BLOCK], labels[a : a + BLOCK], m, *coded(rotated(m), levels))
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return rows.select("vec_id", "label", "v").mapInArrow(each, BLOCKS)


def anchor_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Anchors (vec_id, key, label, v, positives) in blocks; ``positives`` are (id, score) pairs."""

    def each(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ANCHORS):
                b = batch.slice(a, ANCHORS)
                found = b.column("positives").to_pylist()
                pairs = np.array([[len(p) for p in found]], np.int64).tobytes() + np.array([(x["id"], x["score"]) for p in found for x in p], np.int64).tobytes()
                parts = (*(b.column(c).to_numpy().tobytes() for c in ("vec_id", "key", "label")), padded(b.column("v").to_pylist(), size).tobytes(), pairs)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=[c.split()[0] for c in ANCHOR_BLOCKS.split(", ")])

    return rows.select("vec_id", "key", "label", "v", "positives").mapInArrow(each, ANCHOR_BLOCKS)


def _searched(anchors: DataFrame, rows: DataFrame, size: int, levels: int, found, schema: str) -> DataFrame:
    """``found(block, anchor, q, id, key, label, positives)`` rows of every anchor and block of rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                block, out = Block(row, size, levels), []
                ids, keys, labels = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_keys", "q_labels"))
                whole = np.frombuffer(row["q_whole"], np.float64).reshape(len(ids), size)
                turned = rotated(whole)
                exact = float(np.abs(whole).max(initial=0)) * size < 2**50 and block.largest * size < 2**50
                pairs = np.frombuffer(row["q_positives"], np.int64)
                counts, pairs, at = pairs[: len(ids)], pairs[len(ids) :].reshape(-1, 2), 0
                for j in range(len(ids)):
                    own = [(int(a), int(b)) for a, b in pairs[at : at + counts[j]]]
                    at += counts[j]
                    out += found(block, Anchor(turned[j]) if exact else None, whole[j], int(ids[j]), int(keys[j]), int(labels[j]), own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return anchors.crossJoin(rows).mapInArrow(each, schema)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, levels: int = LEVELS
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``vectors`` (vec_id, embedding, label).

    Anchors are the rows with ``is_anchor`` (of vec_id).  A negative's score is
    ``low`` to ``high`` hundredths of the positive's.
    """
    rows = taking_part(vectors)
    size = _size(rows)
    blocks = checkpointed(index(rows, size, levels))
    chosen = rows.where(is_anchor)
    parts = max(1, -(-chosen.count() // ANCHORS))
    chosen = chosen.dropDuplicates(["vec_id", "key"]).repartition(parts, "vec_id")
    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    asked = checkpointed(anchor_blocks(chosen.withColumn("positives", none), size))

    def near(block, anchor, q, own, key, label, _):
        return [(own, key, i, s) for s, i in positives_in(block, anchor, q, own, label, positives)]

    def hard(block, anchor, q, own, key, label, given):
        got = negatives_in(block, anchor, q, label, [band(s, low, high) for _, s in given], negatives)
        return [(own, key, i, s, n, t) for (i, s), found in zip(given, got) for t, n in found]

    of = Window.partitionBy("anchor_id", "key")
    first = _searched(asked, blocks, size, levels, near, "anchor_id long, key long, positive_id long, positive_score long")
    first = first.withColumn("r", F.dense_rank().over(of.orderBy(F.desc("positive_score"), "positive_id"))).where(F.col("r") <= positives)
    pair = F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
    given = first.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_set(pair)).alias("positives")).withColumnRenamed("anchor_id", "vec_id")
    asked = checkpointed(anchor_blocks(chosen.join(given, ["vec_id", "key"]).repartition(parts, "vec_id"), size))
    last = _searched(asked, blocks, size, levels, hard, "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.dense_rank().over(Window.partitionBy("anchor_id", "key", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    out = last.withColumn("rank", rank).where(F.col("rank") <= negatives).distinct()
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
