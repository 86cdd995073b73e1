"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its five-word shingles with their counts.  For
each of K hash functions and each term the gamma-based scheme draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the term alone, quantises the log
weight to ``t = floor(ln w / r + b)`` and scores the term with
``ln c - r (t - b + 1)``; the least score is the sample.  Two documents have
the same sample with a probability that equals their generalised Jaccard
similarity, so the share of equal samples estimates it.  Draws come from
quantile tables indexed by hash bits; a sample is kept as 16 bits of its score.
ln c has 2**20 levels, so the least scores of texts of about a million
different shingles tie more often than they should: such texts look somewhat
more alike than they are.

Rows are dealt to ranges by (doc_id, hash of the text), one task a range, and
the number of ranges grows with the rows; only rows equal in both stay in one
range whatever their number.

Defined results: null is the empty text; a text of one to four words is one
shingle; texts without words have the fingerprint of zeros, are 1 alike among
themselves and 0 to others; rows of one doc_id follow each other in order of a
hash of their text; one document is its own next; a null doc_id sorts first.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import literal_table

SAMPLES = 64
#: Entries of the quantile tables, as a power of two.
TABLE_BITS = 16
#: Terms of whole texts scored at once.
BLOCK = 1 << 13
#: Rows of a range of ids, about; ranges at most; ids sampled for each range to set its bounds; cuts looked up by one array.
ROWS_OF_RANGE, MAX_RANGES, IDS_OF_RANGE, CUTS = 2_500, 1 << 16, 16, 256


def _gamma2_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), by Newton steps from a fair start."""
    x = np.where(p < 0.1, np.sqrt(2 * p), -np.log1p(-p) + np.log1p(-np.log1p(-p)))
    for _ in range(60):
        f = -np.expm1(-x) - x * np.exp(-x) - p
        x = np.maximum(x - np.clip(f / np.maximum(x * np.exp(-x), 1e-300), -1, 1), x / 4)
    return x


def _tables():
    """ln c, r and b by table index; what a term of weight 1 adds to ln c."""

    def make():
        n = 1 << TABLE_BITS
        r = _gamma2_quantiles((np.arange(n) + 0.5) / n)
        fine = _gamma2_quantiles((np.arange(n * 16) + 0.5) / (n * 16))
        lnc = np.log(fine)
        b = ((np.arange(n, dtype=np.uint64) * np.uint64(40503) + np.uint64(12345)) & np.uint64(n - 1)).astype(np.float64) / n  # a permutation: every r meets its own b
        one = r * (b - 1)
        multipliers = tc.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        return lnc.astype(np.float32), r.astype(np.float32), b.astype(np.float32), one.astype(np.float32), multipliers

    return tc.once("cws", make)


def scores(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """K x terms: the score of each term under each hash function."""
    lnc, r, b, one, mult = _tables()
    z = terms[None, :] * mult[:, None]
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    hi = (z >> np.uint64(44)).astype(np.int32)
    lo = ((z >> np.uint64(20)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int32)
    out = lnc.take(hi)
    many = np.flatnonzero(counts > 1)
    if len(many):
        rm, bm, cm = r.take(lo[:, many]), b.take(lo[:, many]), out[:, many]
        t = np.floor(np.log(counts[many].astype(np.float32))[None, :] / rm + bm)
    out += one.take(lo)
    if len(many):
        out[:, many] = cm - rm * (t - bm + 1)
    return out


def _shingle_terms(texts: list[str]) -> list[np.ndarray]:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    offs = np.cumsum([0] + [len(x) for x in data])
    words, first = tc.word_hashes(np.frombuffer(b"".join(data), np.uint8), offs, "space")
    return tc.shingles(words, first)


def signatures(texts: list[str]) -> np.ndarray:
    """Signatures (texts x K, 16 bits each; zeros: no words) of whole texts."""
    out = np.zeros((len(texts), SAMPLES), np.uint16)
    terms = _shingle_terms(texts)
    where, bag, counts = [], [], []

    def flush():
        if not bag:
            return
        s = scores(np.concatenate(bag), np.concatenate(counts))
        starts = np.cumsum([0] + [len(x) for x in bag[:-1]])
        least = np.minimum.reduceat(s, starts, axis=1).T
        bits = tc.mix(np.ascontiguousarray(least).view(np.uint32).astype(np.uint64)) >> np.uint64(48)
        for i, row in zip(where, np.maximum(bits, 1).astype(np.uint16)):
            out[i] = row
        where.clear(), bag.clear(), counts.clear()

    size = 0
    for i, x in enumerate(terms):
        if not len(x):
            continue
        u, c = np.unique(x, return_counts=True)
        if len(u) > BLOCK:  # a long text is scored block by block
            best = None
            for k in range(0, len(u), BLOCK):
                m = scores(u[k : k + BLOCK], c[k : k + BLOCK]).min(axis=1)
                best = m if best is None else np.minimum(best, m)
            out[i] = np.maximum(tc.mix(best.view(np.uint32).astype(np.uint64)) >> np.uint64(48), 1).astype(np.uint16)
            continue
        if size + len(u) > BLOCK:
            flush()
            size = 0
        where.append(i), bag.append(u), counts.append(c)
        size += len(u)
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id and text dealt to ranges of ids, (range, last, doc_id, text), and the number of ranges.

    Each range also holds the first row of the next range, marked ``last``,
    so that every row's next row stands in its own range.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    n_ranges = max(1, min(MAX_RANGES, -(-n // ROWS_OF_RANGE)))
    low = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    key = F.struct(low.alias("i"), F.xxhash64("text").alias("h"))
    cuts: list[tuple[int, int]] = []
    if n_ranges > 1:  # bounds from at most about MAX_RANGES * IDS_OF_RANGE sampled keys; they only balance the ranges
        spread = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
        keys = base.where(spread < min(1.0, IDS_OF_RANGE * n_ranges / n)).select(key.alias("k")).select("k.i", "k.h").toArrow()
        keys = sorted(zip(keys.column(0).to_pylist(), keys.column(1).to_pylist()))
        cuts = sorted({keys[len(keys) * k // n_ranges] for k in range(1, n_ranges)}) if keys else []
    ranged = base.withColumn("range", _range_of(key, cuts).cast("int"))
    firsts = ranged.groupBy("range").agg(F.min(F.struct(low.alias("i"), F.xxhash64("text").alias("h"))).alias("f")).collect()  # one row a range
    used = sorted((r["range"], r["f"]["i"], r["f"]["h"]) for r in firsts)
    # the first row of a range also goes to the range before it, that of the first to the last
    heads = literal_table(spark, [{"i": i, "h": h, "to": used[k - 1][0]} for k, (_, i, h) in enumerate(used)], "i:bigint,h:bigint,to:int")
    sent = ranged.withColumn("__i", low).withColumn("__h", F.xxhash64("text")).join(F.broadcast(heads), (F.col("__i") == F.col("i")) & (F.col("__h") == F.col("h")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("last"))
    both = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("range"), F.lit(True).alias("last"))))
    return sent.select("doc_id", "text", F.explode(both).alias("x")).select("x.range", "x.last", "doc_id", "text"), n_ranges


def _range_of(c, cuts):
    """Number of cuts at or below the key: by halves, and beyond CUTS cuts by halves among every CUTS-th and then inside one array."""
    if len(cuts) <= CUTS:
        return _halves(c, cuts, 0, len(cuts))
    parts = [cuts[k : k + CUTS] for k in range(0, len(cuts), CUTS)]
    part = _halves(c, [p[0] for p in parts[1:]], 0, len(parts) - 1)
    listed = F.from_json(F.lit(json.dumps([[{"i": i, "h": h} for i, h in p] for p in parts])), "array<array<struct<i:bigint,h:bigint>>>")
    return part * CUTS + F.size(F.filter(F.element_at(listed, part + 1), lambda x: x <= c))


def _halves(c, cuts, a, b):
    """Nested comparisons: the place of ``c`` among cuts[a:b], a being those already passed."""
    if a == b:
        return F.lit(a)
    m = (a + b) // 2
    i, h = cuts[m]
    below = (c["i"] < i) | ((c["i"] == i) & (c["h"] < h))
    return F.when(below, _halves(c, cuts, a, m)).otherwise(_halves(c, cuts, m + 1, b))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text of a row has its last floor(n_chars / 2) code points
    replaced by as many of the next row's first ones, or all it has.
    """
    rows, n_ranges = with_next(docs)
    dealt = rows.repartitionById(n_ranges, F.col("range")).sortWithinPartitions("range", "last", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def each(batches):
        held: list[tuple[int, bool, int | None, str]] = []
        prints: dict[str, np.ndarray] = {}

        def done(rows):
            """Rows that all but the last have their next row behind them."""
            mine = [k for k in range(len(rows) - 1) if not rows[k][1]]
            if not mine:
                return None
            edited = []
            for k in mine:
                text, after = rows[k][3], rows[k + 1][3]
                cut = len(text) // 2
                edited.append(text[: len(text) - cut] + after[:cut])
            texts = list(dict.fromkeys([r[3] for r in rows]))
            fresh = [t for t in texts if t not in prints]
            known = {t: prints[t] for t in texts if t in prints}
            known |= dict(zip(fresh, signatures(fresh)))
            prints.clear()
            prints[rows[-1][3]] = known[rows[-1][3]]
            own = np.array([known[rows[k][3]] for k in mine])
            nxt = np.array([known[rows[k + 1][3]] for k in mine])
            new = signatures(edited)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][2] for k in mine], pa.int64()),
                    pa.array([len(rows[k][3]) for k in mine], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array([x.astype(">u2").tobytes().hex() for x in own]),
                    pa.array([x.astype(">u2").tobytes().hex() for x in new]),
                    pa.array(likeness(own, new)),
                    pa.array(likeness(own, nxt)),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            new = list(zip(batch.column("range").to_pylist(), batch.column("last").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()))
            for a in range(0, len(new), 256):
                held += new[a : a + 256]
                # a row marked last has no next row here: what follows it is another range
                out = done(held)
                if out is not None:
                    yield out
                held = held[-1:]

    return dealt.mapInArrow(each, schema)
