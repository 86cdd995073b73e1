"""Texts cut to pages of bounded bytes: at line ends, and long lines between characters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bytes of a page.
PAGE_BYTES = 256 * 1024
#: Texts of a batch that are cut at once.
HELD = 64


def _cut_line(line: str, most: int) -> Iterator[str]:
    """Parts of at most ``most`` bytes, white space at their ends dropped; a character that is longer is a part."""
    raw = line.strip().encode()
    at = 0
    while at < len(raw):
        end = min(len(raw), at + most)
        while end < len(raw) and raw[end] & 0xC0 == 0x80 and end > at:
            end -= 1
        if end == at:  # one character does not fit
            end = at + 1
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
        text = raw[at:end].decode()
        at = end
        rest = raw[at:].decode() if at < len(raw) and raw[at : at + 4].decode("utf-8", "ignore")[:1].isspace() else None
        if rest is not None:
            at += len(rest.encode()) - len(rest.lstrip().encode())
        if text.strip():
            yield text.strip()


def split_pages(text: str | None, most: int = PAGE_BYTES) -> list[str]:
    """The pages of a text, none empty, in one pass over its lines."""
    pages, held, size = [], [], 0
    for line in (text or "").strip().splitlines():
        bytes_ = len(line.encode()) + bool(held)
        if bytes_ > most:
            pages += ["\n".join(held), *_cut_line(line, most)]
            held, size = [], 0
        elif held and size + bytes_ > most:
            pages.append("\n".join(held))
            held, size = [line], bytes_ - 1
        else:
            held.append(line)
            size += bytes_
    pages.append("\n".join(held))
    return [p.strip() for p in pages if p.strip()]


def cut_batch(texts: pa.Array, most: int = PAGE_BYTES) -> pa.Array:
    """The pages of a batch of texts; only ``HELD`` texts at once are Python's own strings."""
    kind = pa.list_(pa.string())
    parts = [pa.array([split_pages(t.as_py(), most) for t in texts.slice(a, HELD)], kind) for a in range(0, len(texts), HELD)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def pages(text: Column, most: int = PAGE_BYTES) -> Column:
    """array<string>: the pages of each text."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return cut_batch(texts, most)

    return cut(text)
