"""Sorted ids as short binary lists, and how many different ids the lists of a key hold.

A list is its first id and then the steps from id to id, seven bits a byte, the
last byte of each number without its high bit.  Ids are whole numbers of 64
bits; steps are taken modulo 2 ** 64, so any of them fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of lists that move in one round, and of sketches, which a task unites before they move; the files of a round are removed before the next.
MOVED, UNITED = 4_000_000_000, 12_000_000_000
#: Ids of one list; bytes of lists that are read at once; ids kept before they are made distinct.
LIST, BYTES, PENDING = 1024, 1 << 20, 1 << 22


def written(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all lists, and where each begins and the last one ends; ``starts``: places of the lists' first ids."""
    steps = ids.astype(np.uint64)
    steps[1:] -= ids[:-1].astype(np.uint64)
    steps[starts] = ids[starts].astype(np.uint64)
    size = np.ones(len(steps), np.int64)
    for k in range(1, 10):
        size += steps >= np.uint64(1 << 7 * k)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.zeros(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        seven = (steps[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][has] + k] = seven | np.where(size[has] > k + 1, 128, 0).astype(np.uint64)
    return out, np.concatenate((at[starts], at[-1:]))


def read(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, and how many each holds."""
    ends = np.flatnonzero(data < 128) + 1
    begins = np.concatenate(([0], ends[:-1]))
    size = ends - begins
    steps = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        steps[has] |= (data[begins[has] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    upto = np.searchsorted(ends, offsets, "right")
    many = np.diff(upto)
    run = np.cumsum(steps, dtype=np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), run))[upto[:-1]]
    return (run - np.repeat(before, many)).astype(np.int64), many


def _bytes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lists = lists.cast(pa.large_binary())
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    return np.frombuffer(lists.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def as_lists(rows: DataFrame, key: str, part: str, item: str) -> DataFrame:
    """(key, part, items, n) of rows that are sorted by these three within their task: lists of at most ``LIST`` different items, a key may have several."""

    def each(batches):
        for batch in batches:
            k, p, ids = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (key, part, item))
            if not len(ids):
                continue
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
            once = new | np.concatenate(([True], ids[1:] != ids[:-1]))
            k, p, ids, new = k[once], p[once], ids[once], new[once]
            place = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            starts = np.flatnonzero(place % LIST == 0)
            data, offsets = written(ids, starts)
            items = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
            many = np.diff(np.concatenate((starts, [len(ids)])))
            yield pa.RecordBatch.from_arrays([pa.array(k[starts]), pa.array(p[starts].astype(np.int32)), items, pa.array(many)], names=[key, part, "items", "n"])

    return rows.select(key, part, item).mapInArrow(each, f"{key} long, {part} int, items binary, n long")


def sent(rows: DataFrame, to: str, key: str, part: str, of: int = 1, nth: int = 0) -> DataFrame:
    """(key, part, items): what a row holds (items) for every id in its list ``to``, which becomes the key; about ``BYTES`` are sent at once.

    Of ids in ``of`` rounds, those of round ``nth`` alone, by their remainder.
    """

    def each(batches):
        for batch in batches:
            data, offsets = _bytes(batch.column(to))
            parts, lists = batch.column(part), batch.column("items").cast(pa.large_binary())
            ids, many = read(data, offsets)
            row = np.repeat(np.arange(batch.num_rows), many)
            if of > 1:
                mine = ids % of == nth
                ids, row = ids[mine], row[mine]
            upto = np.cumsum(np.diff(_bytes(lists)[1])[row] + 16)
            begin = 0
            while begin < len(row):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + BYTES, "right")))
                at = pa.array(row[begin:end])
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin:end]), parts.take(at), lists.take(at).cast(pa.binary())], names=[key, part, "items"])
                begin = end

    return rows.select(to, part, "items").mapInArrow(each, f"{key} long, {part} int, items binary")


def rounds(rows: DataFrame, most: int) -> int:
    """In how many rounds the rows (items, and m, the ids in their list) are sent, each of about ``most`` bytes: a prime number, so that ids in steps fall into all of them."""
    n = -(-(rows.agg(F.sum(F.col("m") * (F.octet_length("items") + 16))).first()[0] or 0) // most) or 1
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _different(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group's number and an id, each once, sorted; groups are in order."""
    low = ids.min()
    above = (ids - low).astype(np.uint64)
    bits = int(above.max()).bit_length()
    if bits + int(group[-1]).bit_length() <= 64:
        both = np.sort((group.astype(np.uint64) << np.uint64(bits)) | above) if bits < 64 else np.sort(above)
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        group = (both >> np.uint64(bits)).astype(np.int64) if bits < 64 else np.zeros(len(both), np.int64)
        return group, (both & np.uint64((1 << bits) - 1)).astype(np.int64) + low
    order = np.lexsort((ids, group))
    group, ids = group[order], ids[order]
    keep = np.concatenate(([True], (group[1:] != group[:-1]) | (ids[1:] != ids[:-1])))
    return group[keep], ids[keep]


def counted(rows: DataFrame, key: str, part: str) -> DataFrame:
    """(key, part, n): how many different ids other than the key itself the lists (items) of a key and part hold, from rows sorted by both within their task.

    About ``BYTES`` of lists are read at once; of a key that goes on, the ids met
    so far are held once.
    """

    def each(batches):
        at, held, pending = None, [], 0  # the last key and part, its ids so far

        def ended():
            ids = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            return at[0], at[1], len(ids) - int(np.searchsorted(ids, at[0], "right") - np.searchsorted(ids, at[0], "left"))

        def out(done):
            k, p, n = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int32()), pa.array(n, pa.int64())], names=[key, part, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, parts = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (key, part))
            data, offsets = _bytes(batch.column("items"))
            begin = 0
            while begin < len(keys):
                end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BYTES, "right")) - 1)
                k, p = keys[begin:end], parts[begin:end]
                ids, many = read(data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
                new = np.concatenate(([False], (k[1:] != k[:-1]) | (p[1:] != p[:-1])))
                number, firsts = np.cumsum(new), np.concatenate(([0], np.flatnonzero(new)))
                group, ids = _different(np.repeat(number, many), ids)
                bounds = np.searchsorted(group, np.arange(len(firsts) + 1))
                k, p, done = k[firsts], p[firsts], []
                if at is not None and at != (k[0], p[0]):
                    done.append(ended())
                    held, pending = [], 0
                at = (int(k[0]), int(p[0]))
                held.append(ids[bounds[0] : bounds[1]])
                pending += len(held[-1])
                if len(k) > 1:
                    done.append(ended())
                    own = np.bincount(group[ids == k[group]], minlength=len(k))
                    done += zip(k[1:-1].tolist(), p[1:-1].tolist(), (np.diff(bounds) - own)[1:-1].tolist())
                    at, held = (int(k[-1]), int(p[-1])), [ids[bounds[-2] :].copy()]
                    pending = len(held[0])
                elif len(held) > 1 and pending > max(PENDING, 2 * len(held[0])):
                    held = [np.unique(np.concatenate(held))]
                    pending = len(held[0])
                if done:
                    yield out(done)
                begin = end
        if at is not None:
            yield out([ended()])

    return rows.select(key, part, "items").mapInArrow(each, f"{key} long, {part} int, n long")
