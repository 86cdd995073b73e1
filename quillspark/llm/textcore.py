"""Vectorised tokenising over Arrow string buffers.

All functions work on the raw UTF-8 bytes of a batch: words and shingles get
64-bit hashes from numpy operations over whole pieces of a batch, so that no
Python object is made per word.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; also the span over which one run of prefix hashes reaches.
PIECE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C55
SPACE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
WORDS_IN_SHINGLE = 5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def once(key: str, make: Callable):
    """``make()``, kept for the life of the process (a Python worker serves many tasks)."""
    kept = sys.__dict__.setdefault("_quillspark_tables", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""

    def make():
        up = np.full(PIECE_BYTES + 1, BASE, np.uint64)
        down = np.full(PIECE_BYTES + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)

    return once("powers", make)


def alphabet(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, random value of the byte) for ``space``: words are runs of non-space,
    ``alnum``: runs of ASCII letters, digits and non-ASCII; both with A-Z lower-cased;
    ``exact``: as ``space`` with case kept."""
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if kind != "exact":
        value[65:91] = value[97:123]
    word = np.ones(256, bool)
    if kind == "alnum":
        word[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            word[a:b] = True
    else:
        word[SPACE] = False
    return word, value


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def small(batches, rows: int = 1024):
    """The batches in slices of ``rows`` rows, which bounds what a worker holds of long texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a row is never split."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def span_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, stop); spans ascend and do not overlap."""
    up, down = powers()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(stop, base + PIECE_BYTES, "right")))
        if stop[i] - base > PIECE_BYTES:  # one huge word: hashed slice by slice
            h = np.uint64(0)
            for k in range(int(base), int(stop[i]), PIECE_BYTES):
                cut = buf[k : min(k + PIECE_BYTES, int(stop[i]))]
                h = mix(np.asarray([h + (value[cut] * up[: len(cut)]).sum(dtype=np.uint64)], np.uint64))[0]
            out[i] = h
            i += 1
            continue
        part = buf[base : stop[j - 1]]
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * up[: len(part)], out=run[1:])
        s, e = start[i:j] - base, stop[i:j] - base
        out[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def word_spans(buf: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each row (rows + 1 values)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = word[buf]
    edge = offs[(offs > 0) & (offs < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    stop = np.flatnonzero(inside & ~after) + 1
    return start, stop, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of the first word of each row."""
    word, value = alphabet(kind)
    start, stop, first = word_spans(buf, offs, word)
    return span_hashes(buf, start, stop, value), first


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, rows not regarded."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total += words[k : k + n] * np.uint64(pow(0xA0761D6478BD642F, k + 1, 1 << 64))
    return mix(total + np.uint64(length))


def shingles(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per row the hashes of its five-word shingles with repeats; a shorter row is one shingle, an empty row none."""
    runs = run_hashes(words, WORDS_IN_SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS_IN_SHINGLE:
            out.append(runs[a : b - WORDS_IN_SHINGLE + 1])
        elif b > a:
            out.append(run_hashes(words[a:b], b - a))
        else:
            out.append(runs[:0])
    return out


def set_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with ``values`` as its last column ``name``, in place of one of that name."""
    keep = [i for i, c in enumerate(batch.schema.names) if c.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])
