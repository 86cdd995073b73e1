"""Quality classifier: hashed word n-gram logistic regression, trained with FTRL.

Features are word n-grams (one and two words) hashed to 2**HASH_BITS cells,
of the words as they stand and of their shapes (runs of one class of
character as one mark, so that new words share features with known ones).
Cells get log-scaled counts, scaled to one length.  Training follows the regularised
leader (per-coordinate FTRL-proximal) in a fixed number of tasks, each over
its own part of a bounded sample of labelled rows; their weights are averaged,
broadcast and applied as sparse dot products to whole texts.

Defined results: null, empty and wordless texts score by the bias alone;
labels other than 0 and 1 and labels of unknown ids teach nothing; a document
with several labels teaches each; with no usable label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import extended, without

HASH_BITS = 18
#: Labelled rows learned from: about so many at most, sampled by hash; a part of them for each training task.
MAX_ROWS, TASKS = 12_000, 6
PASSES = 4
#: Length of a feature vector; FTRL's rates and regularisation.
LENGTH = 16.0
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05


def _shapes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with every run of one character class inside a word as one mark, and the rows' new bounds."""
    kind = np.arange(256, dtype=np.uint8)
    kind[97:123] = 97
    kind[128:] = 97
    kind[65:91] = 65
    kind[48:58] = 48
    kind[tc.SPACE] = 32
    x = kind[buf]
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    edge = offs[(offs > 0) & (offs < len(x))]
    keep[edge] = True
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


def features(column: pa.Array):
    """(row, cells, values) of each row of a string column; whole texts."""
    buf, offs = tc.buffers(column)
    for a, b in tc.pieces(offs):
        part, at = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        runs = []
        for salt, (data, bounds) in enumerate(((part, at), _shapes(part, at))):
            words, first = tc.word_hashes(data, bounds, "exact")
            runs.append((first, [tc.run_hashes(words, k) ^ np.uint64(salt) for k in (1, 2)]))
        for i in range(b - a):
            got = []
            for first, grams in runs:
                for k, g in enumerate(grams):
                    got.append(g[first[i] : max(first[i], first[i + 1] - k)])
            cells, n = np.unique((np.concatenate(got) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS), return_counts=True)
            v = np.log1p(n)
            yield a + i, cells.astype(np.int64), v * (LENGTH / np.sqrt((v * v).sum())) if len(v) else v


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES) -> np.ndarray:
    """FTRL-proximal weights (the last one is the bias) from (cells, values, label) rows in order."""
    size = 1 << HASH_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(passes):
        for cells, values, label in rows:
            at, x = np.append(cells, size), np.append(values, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weight(np.arange(size + 1))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, tasks: int = TASKS) -> np.ndarray:
    """Weights from ``labels`` (doc_id, quality) of ``docs``, as float32 with the bias last."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    n = usable.count()
    spread = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = usable.where(spread < min(1.0, max_rows / max(1, n)))  # about max_rows rows of 12 bytes: a proven bound
    part = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.lit(tasks)).cast("int")
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select(part.alias("part"), F.xxhash64(F.lit(5), "doc_id").alias("place"), "text", "label")

    def fit(key, t):
        t = t.sort_by([("place", "ascending"), ("label", "ascending")])
        texts, label = t.column("text").combine_chunks(), t.column("label").to_pylist()
        w = follow_leader([(c, v, label[i]) for i, c, v in features(texts)])
        return pa.table({"n": pa.array([len(label)], pa.int64()), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary())})

    got = rows.groupBy("part").applyInArrow(fit, "n long, weights binary").collect()  # `tasks` rows of 1 MB
    total = sum(r["n"] for r in got)
    out = np.zeros((1 << HASH_BITS) + 1)
    for r in sorted(got, key=lambda r: bytes(r["weights"])):
        out += np.frombuffer(r["weights"], np.float32).astype(np.float64) * r["n"] / total
    return out.astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with score, the probability of label 1."""
    base = docs.select(*without(docs, "score"))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def each(batches):
        w = shared.value
        for batch in tc.small(batches):
            out = np.zeros(batch.num_rows)
            for i, cells, values in features(batch.column(batch.schema.get_field_index("text"))):
                out[i] = w[cells] @ values + w[-1]
            yield tc.set_column(batch, "score", pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))), pa.float64()))

    return base.mapInArrow(each, extended(base.schema, "score double"))
