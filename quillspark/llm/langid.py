"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, languages x 2**HASH_BITS, counted
by Spark over a bounded sample of labelled rows and broadcast; whole texts are
scored batch by batch in numpy.  Every language is learned: more than
BLOCK_LANGS are scored in blocks, one pass each, with a running best and sum.
Character n-grams (one to three code points) come from the lower-cased text
with all but letters and marks as spaces; code points above U+FFFF stay as
they are.

Defined results: a null text, or one with no letter (Unicode category L), is
``und`` with score 0; so is every text if nothing was learned.  Rows with a null lang teach nothing.
Ties go to the first language by code point.  Repeated rows score alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, extended, literal_table, without

HASH_BITS = 15
ORDERS = (1, 2, 3)
#: Rows learned from are sampled by hash down to about this many of each language; their texts are read whole.
ROWS_OF_LANG = 3000
ALPHA = 0.5
#: Languages scored at once; bounds the broadcast matrix (34 MB at 2**15 cells in float32).
BLOCK_LANGS = 256
LETTER = re.compile(r"[^\W\d_]")  # letters, and numerals such as a half


def has_letter(text: str | None) -> bool:
    """Whether any character is of Unicode category L."""
    return any(m[0].isalpha() for m in LETTER.finditer(text or ""))


def _fold():
    """Code point -> code point: lower-cased letters and marks; all else a space (for the Basic Multilingual Plane)."""

    def make():
        out = np.full(1 << 16, 32, np.uint32)
        for c in range(1 << 16):
            x = chr(c)
            if unicodedata.category(x)[0] in "LM":
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        return out

    return tc.once("fold", make)


def _cells(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells of all n-grams of the texts, per order, and the bounds of each text in the joined text (one space on either side)."""
    joined = "".join(f" {t} " for t in texts)
    bounds = np.cumsum([0] + [len(t) + 2 for t in texts])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(cp < (1 << 16), _fold()[cp & 0xFFFF], cp).astype(np.uint64)
    out, total = [], np.zeros(len(cp), np.uint64)
    for k in range(max(ORDERS)):
        if k:
            total = total[:-1] * np.uint64(0x9E3779B97F4A7C15) + cp[k:]
        else:
            total = cp + np.uint64(1)
        if k + 1 in ORDERS:
            h = (total + np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            out.append((h >> np.uint64(64 - HASH_BITS)).astype(np.int64))
    return out, bounds


def held_out(doc_id: Column | str, of: int, remainder: int) -> Column:
    """crc32 of the id as text modulo ``of``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == remainder


class Blocks(NamedTuple):
    """A model of more languages than one matrix holds: all languages, sorted, and their counts (lang, cell, n)."""

    langs: list[str]
    counts: DataFrame
    size: int

    def __iter__(self) -> Iterator[tuple[list[str], np.ndarray]]:
        for k in range(0, len(self.langs), self.size):
            part = self.langs[k : k + self.size]
            yield part, _matrix(part, self.counts.where(F.col("lang").between(part[0], part[-1])))


def _matrix(langs: list[str], counts: DataFrame) -> np.ndarray:
    """Log probabilities (languages x cells); at most that many rows reach the driver."""
    got = counts.toArrow()
    table = np.full((len(langs), 1 << HASH_BITS), ALPHA)
    where = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (np.array([where[x] for x in got.column("lang").to_pylist()], np.int64), got.column("cell").to_numpy()), got.column("n").to_numpy())
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def train(docs: DataFrame, rows_of_lang: int = ROWS_OF_LANG, block: int = BLOCK_LANGS) -> tuple[list[str], np.ndarray] | Blocks:
    """Languages and log probabilities (languages x cells) from the text and lang of ``docs``; ``Blocks`` for more than ``block`` languages."""
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().collect()  # a row a language
    langs = sorted((r["lang"] for r in sizes), key=str.encode)
    if not langs:
        return [], np.zeros((0, 1 << HASH_BITS), np.float32)
    share = literal_table(docs.sparkSession, [{"lang": r["lang"], "__share": min(1.0, rows_of_lang / r["count"])} for r in sizes], "lang string, __share double")
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(F.broadcast(share), "lang").where(spread < F.col("__share")).select("lang", F.col("text").cast("string"))

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def counted():
            for lang, into in total.items():
                at = np.flatnonzero(into)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at], pa.int64())], names=["lang", "cell", "n"])
            total.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in total and len(total) >= BLOCK_LANGS:
                    yield from counted()
                cells, _ = _cells([text])
                into = total.setdefault(lang, np.zeros(1 << HASH_BITS, np.int64))
                for c in cells:
                    into += np.bincount(c, minlength=1 << HASH_BITS)
        yield from counted()

    counts = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    return Blocks(langs, checkpointed(counts), block) if len(langs) > block else (langs, _matrix(langs, counts))


def _logs(texts: list[str], logp: np.ndarray) -> np.ndarray:
    """Log probability of each text in each language (languages x texts)."""
    cells, bounds = _cells(texts)
    logs = np.zeros((len(logp), len(texts)))
    for order, c in zip(ORDERS, cells):
        start = np.minimum(bounds[:-1], len(c) - 1)
        across = (bounds[1:-1, None] - np.arange(1, order)).ravel()  # these reach into the next text
        for j in range(len(logp)):
            each = logp[j][c].astype(np.float64)
            each[across] = 0.0
            logs[j] += np.add.reduceat(each, start)
    return logs


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | Blocks) -> DataFrame:
    """``docs`` with lang_pred and score, the probability of that language; texts are read whole."""
    if isinstance(model, Blocks):
        return _identify_blocks(docs, model)
    base = docs.select(*without(docs, "lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        langs, logp = shared.value
        for batch in tc.small(batches):
            column = batch.column(batch.schema.get_field_index("text"))
            _, offs = tc.buffers(column)
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for a, b in tc.pieces(offs) if langs else ():
                part = column.slice(a, b - a).to_pylist()
                ok = [i for i, t in enumerate(part) if has_letter(t)]
                if not ok:
                    continue
                logs = _logs([part[i] for i in ok], logp)
                order = np.argmax(logs, axis=0)
                top = logs.max(axis=0)
                p = 1.0 / np.exp(np.maximum(logs - top, -700)).sum(axis=0)
                for k, i in enumerate(ok):
                    pred[a + i], score[a + i] = langs[order[k]], min(1.0, float(p[k]))
            yield tc.set_column(tc.set_column(batch, "lang_pred", pa.array(pred, pa.string())), "score", pa.array(score, pa.float64()))

    return base.mapInArrow(each, extended(base.schema, "lang_pred string, score double"))


def _identify_blocks(docs: DataFrame, model: Blocks) -> DataFrame:
    """As ``identify``: after each block ``__top`` is the best log probability so far and ``score`` the sum of all, relative to it."""
    out = docs.select(*without(docs, "lang_pred", "score")).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "__top": F.lit(float("-inf"))})

    def one(shared):
        def each(batches):
            langs, logp = shared.value
            for batch in tc.small(batches):
                column, was, total, top = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "lang_pred", "score", "__top"))
                _, offs = tc.buffers(column)
                pred, total, top = was.to_pylist(), np.array(total.to_pylist()), np.array(top.to_pylist())
                for a, b in tc.pieces(offs):
                    part = column.slice(a, b - a).to_pylist()
                    ok = [i for i, t in enumerate(part) if has_letter(t)]
                    if not ok:
                        continue
                    at = a + np.array(ok)
                    logs = _logs([part[i] for i in ok], logp)
                    best, order = logs.max(axis=0), np.argmax(logs, axis=0)
                    for k, i in enumerate(at):
                        if best[k] > top[i]:
                            pred[i] = langs[order[k]]
                    new = np.maximum(top[at], best)
                    total[at] = total[at] * np.exp(np.maximum(top[at] - new, -700)) + np.exp(np.maximum(logs - new, -700)).sum(axis=0)
                    top[at] = new
                for name, value in (("lang_pred", pa.array(pred, pa.string())), ("score", pa.array(total, pa.float64())), ("__top", pa.array(top, pa.float64()))):
                    batch = tc.set_column(batch, name, value)
                yield batch

        return each

    for k, block in enumerate(model):
        out = out if k == 0 else checkpointed(out)
        out = out.mapInArrow(one(docs.sparkSession.sparkContext.broadcast(block)), out.schema)
    return out.withColumn("score", F.when(F.col("score") > 0, F.least(F.lit(1.0), 1 / F.col("score"))).otherwise(0.0)).drop("__top")
