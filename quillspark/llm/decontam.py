"""Benchmark decontamination with suffix arrays over the training text.

Words are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII
characters.  A window is 10 consecutive words of a benchmark item; an item of
one to nine words is one window.  Every piece of a batch of documents is a
shard: all its suffixes are ordered by prefix doubling, by their first 1, 2, 4,
8 words and so on up to the window's length, which makes the shard's suffix
array.  Every suffix of the benchmark is found by binary search at each length,
and only those found go on to the next; a shard that none reaches is not
ordered further.  Neighbouring hits on one diagonal are merged to longest
verbatim matches with their places in document and item.  Only the benchmark,
a stated query set, travels to the executors, in tables of a checked size;
documents never move.

Defined results: null or wordless texts have no words, no hits and are clean;
items of null or wordless text have no windows; repeated rows and items each
count; items of equal text are all reported; all items of a null id are one
item, whose hits count and whose null stands first in ``items``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, extended, without

WINDOW = 10
#: Words of the benchmark sent to the executors at once: about 30 bytes of each, 60 MB in all.
TABLE_WORDS = 2_000_000
MATCH = "array<struct<item_id:string,doc_word:int,item_word:int,n_words:int>>"
MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int32()), ("item_word", pa.int32()), ("n_words", pa.int32())]))


class Windows(NamedTuple):
    """Words and windows of (a part of) a benchmark; every word that starts a window is a suffix to search for."""

    items: list[str | None]
    width: int
    vocabulary: np.ndarray  # distinct word hashes, sorted
    word: np.ndarray  # each word of the items, one item after the other, as a place in the vocabulary
    stop: np.ndarray  # where the item of each word ends
    size: np.ndarray  # words of the window that begins here; 0: none
    owner: np.ndarray  # number of its item
    place: np.ndarray  # its place in the item
    goes_on: bool  # the first item began in the table before


def windows(items: list[tuple[str | None, str]], width: int = WINDOW, most: int = TABLE_WORDS) -> Iterator[Windows]:
    """All windows of (item_id, text) rows, in tables of up to about ``most`` words; an item of fewer words than ``width`` is one window.

    A longer item is cut with ``width - 1`` words on both sides of the cut.
    """
    parts: list[tuple[str | None, np.ndarray, int, int]] = []  # item, its words, first window, windows
    goes_on = False
    for item, text in items:
        buf = np.frombuffer((text or "").encode(), np.uint8)
        words, _ = tc.word_hashes(buf, np.array([0, len(buf)], np.int64), "alnum")
        n = max(len(words) - width + 1, 1) if len(words) else 0
        for lo in range(0, n, most):
            if parts and sum(len(w) for _, w, _, _ in parts) + min(len(words) - lo, most) > most:
                yield _table(parts, width, goes_on)
                parts, goes_on = [], lo > 0
            hi = min(n, lo + most)
            parts.append((item, words[lo : hi + width - 1], lo, hi - lo))
    yield _table(parts, width, goes_on)


def _table(parts: list[tuple], width: int, goes_on: bool) -> Windows:
    none = np.zeros(0, np.int64)
    lengths = np.array([len(w) for _, w, _, _ in parts], np.int64)
    vocabulary, word = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _, _ in parts)]), return_inverse=True)
    size = np.concatenate([none, *(np.where(np.arange(len(w)) < n, min(len(w), width), 0) for _, w, _, n in parts)])
    place = np.concatenate([none, *(lo + np.arange(len(w)) for _, w, lo, _ in parts)])
    stop = np.repeat(np.cumsum(lengths), lengths)
    return Windows([i for i, *_ in parts], width, vocabulary, word.astype(np.int32), stop.astype(np.int32), size.astype(np.int8 if width < 128 else np.int32), np.repeat(np.arange(len(parts), dtype=np.int32), lengths), place.astype(np.int32), goes_on)


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, distinct keys, and the rank of each among them from 1 on."""
    order = np.argsort(key)
    at = key[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    rank = np.empty(len(at), np.int64)
    rank[order] = np.cumsum(new)
    return order, at[new], rank


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rank from 1 on of each wanted key among the sorted keys, by binary search; 0 if it is not there."""
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at + 1, 0)


def _pairs(rank: np.ndarray, ahead: int, stop: np.ndarray, base: int) -> np.ndarray:
    """One number for the ranks at each place and ``ahead`` places on (0 behind the end of its text)."""
    on = np.arange(ahead, len(rank) + ahead)
    return rank * base + np.where(on < stop, rank[np.minimum(on, len(rank) - 1)], 0)


def _scan(words: np.ndarray, first: np.ndarray, table: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word in the row and window (its first word in the table) of every occurrence of a window of ``table`` in a piece of text."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(table.word):
        return none, none, none
    base = len(words) + 1
    stop = np.repeat(first[1:], np.diff(first))
    order, known, rank = _ordered(words)
    found = _find(known, table.vocabulary)[table.word]  # rank of each word of the benchmark here
    got, length = [], 1
    sizes = sorted(set(np.unique(table.size).tolist()) - {0})
    while sizes:
        for size in [s for s in sizes if length <= s < 2 * length]:  # windows whose length two overlapping spans make
            due = np.flatnonzero((table.size == size) & (found > 0))
            if size > length and len(due):
                due = due[found[due + size - length] > 0]
            if not len(due):
                continue
            if size == length:
                array, ranks, wanted = order, rank, found[due]
            else:
                array, keys, ranks = _ordered(_pairs(rank, size - length, stop, base))
                wanted = _find(keys, found[due] * base + found[due + size - length])
                due, wanted = due[wanted > 0], wanted[wanted > 0]
            sorted_ranks = ranks[array]  # along the shard's suffix array
            a, z = np.searchsorted(sorted_ranks, wanted, "left"), np.searchsorted(sorted_ranks, wanted, "right")
            n = z - a
            got.append((array[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)], np.repeat(due, n)))
        sizes = [s for s in sizes if s >= 2 * length]
        if not sizes:
            break
        # twice the length: of the suffixes of the benchmark only those found so far are searched for
        due = np.flatnonzero(found > 0)
        due = due[due + length < table.stop[due]]
        due = due[found[due + length] > 0]
        if not len(due):
            break
        order, keys, new = _ordered(_pairs(rank, length, stop, base))
        wanted = found[due] * base + found[due + length]
        found = np.zeros(len(found), np.int64)
        found[due] = _find(keys, wanted)
        rank, length = new, 2 * length
    if not got:
        return none, none, none
    spot, query = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    row = np.searchsorted(first, spot, "right") - 1
    return row, spot - first[row], query


def _add_matches(longest: list[list[dict]], rows: np.ndarray, at: np.ndarray, query: np.ndarray, table: Windows) -> None:
    """Merges the occurrences of each row and diagonal to longest verbatim matches and adds them to ``longest``."""
    diagonal: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    owner, place = table.owner[query], table.place[query]
    for r, k, d, s, e in zip(rows.tolist(), owner.tolist(), (at - place).tolist(), at.tolist(), (at + table.size[query]).tolist()):
        diagonal[r, k, d].append((s, e))
    for (r, k, d), spans in diagonal.items():
        spans.sort()
        lo, hi = spans[0]
        for s, e in [*spans[1:], (1 << 60, 0)]:
            if s > hi:
                longest[r].append({"item_id": table.items[k], "doc_word": lo, "item_word": lo - d, "n_words": hi - lo})
                lo, hi = s, e
            hi = max(hi, e)


def _by_id(item_id: str | None) -> tuple[bool, str]:
    """Sort key of ids: null first."""
    return item_id is not None, item_id or ""


def _covered(matches: list[dict]) -> int:
    """Words inside any match."""
    total = end = 0
    for a, z in sorted((m["doc_word"], m["doc_word"] + m["n_words"]) for m in matches):
        total += max(0, z - max(a, end))
        end = max(end, z)
    return total


def _joined(matches: list[dict], item: str | None) -> list[dict]:
    """The matches, those of an item that was cut between two tables merged where they overlap on one diagonal."""
    out, ends = [], {}
    for m in sorted(matches, key=lambda m: m["doc_word"]):
        d = m["doc_word"] - m["item_word"]
        last = ends.get(d) if m["item_id"] == item else None
        if last is not None and m["doc_word"] <= last["doc_word"] + last["n_words"]:
            last["n_words"] = max(last["n_words"], m["doc_word"] + m["n_words"] - last["doc_word"])
            continue
        out.append(m)
        if m["item_id"] == item:
            ends[d] = m
    return out


def _search(docs: DataFrame, table: Windows, only_clean: bool, again: bool) -> DataFrame:
    """One pass over ``docs`` with one table of the benchmark; ``again``: add to the matches of earlier tables."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(table))  # plain values: workers may not have this module
    added = [("n_words", "bigint", pa.int64()), ("n_hit", "bigint", pa.int64()), ("items", "array<string>", pa.list_(pa.string())), ("matches", MATCH, MATCH_ARROW)]

    def each(batches):
        table = Windows(*shared.value)
        for batch in tc.small(batches):
            buf, offs = tc.buffers(batch.column(batch.schema.get_field_index("text")))
            n_words = np.zeros(batch.num_rows, np.int64)
            longest = batch.column(batch.schema.get_field_index("matches")).to_pylist() if again and not only_clean else [[] for _ in range(batch.num_rows)]
            for a, b in tc.pieces(offs):
                words, first = tc.word_hashes(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], "alnum")
                n_words[a:b] = np.diff(first)
                rows, at, query = _scan(words, first, table)
                _add_matches(longest, rows + a, at, query, table)
            if only_clean:
                yield batch.filter(pa.array([not m for m in longest], pa.bool_()))
                continue
            if table.goes_on:
                longest = [_joined(m, table.items[0]) for m in longest]
            for m in longest:
                m.sort(key=lambda x: (x["doc_word"], _by_id(x["item_id"]), x["item_word"]))
            for (name, _, kind), value in zip(added, (n_words, [_covered(m) for m in longest], [sorted({x["item_id"] for x in m}, key=_by_id) for m in longest], longest)):
                batch = tc.set_column(batch, name, pa.array(value, kind))
            yield batch

    if only_clean:
        return docs.mapInArrow(each, docs.schema)
    base = docs if again else docs.select(*without(docs, *(n for n, _, _ in added)))
    return base.mapInArrow(each, base.schema if again else extended(base.schema, ", ".join(f"{name} {ddl}" for name, ddl, _ in added)))


def _tables(benchmark: DataFrame, width: int, most: int) -> Iterator[Windows]:
    """The windows of the benchmark; the driver holds about ``most`` words of it at once, or one longer item."""
    items = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    items = items.withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[A-Z]+"), 0)).cast("long"))  # at least as many as the words
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= most:
        yield from windows([(r[0], r[1]) for r in items.select("item_id", "text").collect()], width, most)
        return
    half = max(1, most // 2)
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("item_id", "text")).rowsBetween(Window.unboundedPreceding, -1))
    placed = checkpointed(items.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / half)))  # a row an item
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        yield from windows([(r[0], r[1]) for r in placed.where(F.col("block") == block).select("item_id", "text").collect()], width, most)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, only_clean: bool = False, block_words: int = TABLE_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (distinct, sorted as strings) and matches.

    ``matches`` holds the longest verbatim matches: (item_id, doc_word,
    item_word, n_words).  With ``only_clean``: the rows of ``docs`` without a
    hit, as they were.  A benchmark of more than ``block_words`` words is
    searched in tables of about so many, one pass each, with the rows written to
    the shared folder in between.
    """
    out = docs
    for k, table in enumerate(_tables(benchmark, width, max(block_words, width))):
        out = _search(out if k == 0 else checkpointed(out), table, only_clean, k > 0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = TABLE_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    return matches(docs, benchmark, width, True, block_words)
