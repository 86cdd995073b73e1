"""Sum-of-squares packing of tokenised documents into sequences.

Every document becomes its token ids and an end id, and only what is longer
than a sequence is cut.  Pieces that fill a sequence are one.  The others are
dealt to parts at random, longest first inside a part: a piece goes to the
open sequence that leaves the sum of the squared counts of open sequences per
residual gap smallest, and opens a new one only where none has room.  The
rule costs one pass over the counts of gaps for a piece, whatever the number
of sequences, and a part ends within about one sequence of the least number.

Parts hold about ``PART`` pieces at any input size, so no task grows; the text
is read once and never shuffled.  Pieces are written to the checkpoint folder
with a number, which deals them to parts: a lost executor's rows come out the
same again, and repeated rows spread like others.

Defined results: null texts are empty and give the end id alone; rows of one
doc_id, or of none, are each a document; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import kept_words

CAPACITY = 2048
#: Pieces of a part, about.
PART = 32_768
#: The largest tokenizer file that is sent to executors, in bytes.
MOST_TOKENIZER = 64 << 20


def cut(ids: Iterator[bytes], end_id: int, capacity: int) -> Iterator[bytes]:
    """Pieces of ``capacity`` ids, the last one ending in ``end_id``, as little-endian bytes."""
    held, size = bytearray(), capacity * 4
    for more in ids:
        held += more
        if len(held) >= size:
            whole = len(held) // size * size
            for a in range(0, whole, size):
                yield bytes(held[a : a + size])
            del held[:whole]
    held += int(end_id).to_bytes(4, "little")
    yield bytes(held)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, with ``ids`` (array<long>) if they are kept."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = f.read()
    if len(vocabulary) > MOST_TOKENIZER:
        raise ValueError(f"the tokenizer has over {MOST_TOKENIZER} characters")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def each(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        words = kept_words(sent.value)

        def batch_of(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], like), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cols[5]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            ids, texts, out = batch.column("doc_id"), batch.column("text"), []
            for k, said in enumerate(words.all_encoded(t.as_py() for t in texts)):
                doc, start = ids[k].as_py(), 0
                for n, piece in enumerate(cut(said, end_id, capacity)):
                    out.append((doc, n, start, len(piece) // 4, zlib.crc32(piece), *[piece] * keep_ids))
                    start += len(piece) // 4
                    if len(out) >= (256 if keep_ids else 8192):
                        yield batch_of(out, ids.type)
                        out = []
            if out:
                yield batch_of(out, ids.type)

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the place in it of each piece, longest pieces first.

    ``open_[g]`` counts open sequences with a gap of g.  Moving one from gap g
    to g - s changes the sum of squares by 2 (open_[g - s] - open_[g]) + 2, or
    by 1 - 2 open_[g] where it is filled; the least change wins, ties by the
    smaller gap.
    """
    where, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_, by_gap, made = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0
    never = np.int64(1) << 60
    for k in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[k])
        room = open_[s:capacity]
        at = -1
        if s < capacity and room.any():
            change = 2 * (open_[: capacity - s] - room) + 2
            change[0] -= 1
            at = int(np.where(room > 0, change, never).argmin())
        if at < 0:
            where[k], gap = made, capacity
            made += 1
        else:
            gap = s + at
            where[k] = by_gap[gap].pop()
            open_[gap] -= 1
        place[k] = capacity - gap
        if gap > s:
            by_gap[gap - s].append(int(where[k]))
            open_[gap - s] += 1
    return where, place


def pack(rows: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """``rows`` (with a ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Sequence ids are negative where one piece fills the sequence; no two
    sequences share one.
    """
    numbered = checkpointed(rows.withColumn("__ql_n", F.monotonically_increasing_id()))
    short = numbered.where(F.col("length") < capacity)
    parts = max(1, -(-short.count() // part))
    full = numbered.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("__ql_n")).withColumn("offset", F.lit(0).cast("long"))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("__ql_n")
        where, at = sum_of_squares(table.column("length").to_numpy(), capacity)
        base = table.column("__ql_part")[0].as_py() << 32
        return table.drop_columns(["__ql_part", "__ql_n"]).append_column("sequence_id", pa.array(base + where)).append_column("offset", pa.array(at))

    dealt = short.withColumn("__ql_part", F.pmod(F.xxhash64("__ql_n"), F.lit(parts)))
    names = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return dealt.groupBy("__ql_part").applyInArrow(place, f"{names}, sequence_id long, offset long").unionByName(full.drop("__ql_n"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts) of packed pieces that kept their ids; a sequence is short, so it is put together in a row."""
    each = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    got = packed.groupBy("sequence_id").agg(each.alias("p"))
    return got.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity, end_id, keep_ids), capacity)
