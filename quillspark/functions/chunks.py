"""Column functions that cut texts by what they are: diffs, logs, tables, settings, chats, token windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Rows of a table part, lines of a settings part, turns and words of a chat part, tokens of a window and their overlap.
TABLE_ROWS, SECTION_LINES = 40, 60
CHAT_TURNS, CHAT_WORDS = 6, 180
WINDOW_TOKENS, WINDOW_OVERLAP = 240, 24
SETTING = r"(\{$)|(^[A-Za-z0-9_.-]+\s*:)"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def _begun_by(text: Column, pattern: str) -> Column:
    """The text cut before each line that begins with ``pattern``; parts stripped, empty ones dropped."""
    return _filled(F.transform(F.split(F.coalesce(text, F.lit("")), f"(?m)(?=^{pattern})"), stripped))


def diff_chunks(text: Column) -> Column:
    """A part per file of a diff."""
    return _begun_by(text, "diff --git ")


def log_chunks(text: Column) -> Column:
    """A part per event: a line with a leading date, or a traceback, and what follows it."""
    return _begun_by(text, r"(?:\d{4}-\d{2}-\d{2}[ T]|Traceback )")


def _lines(text: Column) -> Column:
    """Lines that are not blank, without white space at their ends."""
    return _filled(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.regexp_replace(x, r"\s+$", "")))


def _runs(lines: Column, size: int) -> Column:
    """The lines in runs of ``size``."""
    last = F.floor((F.size(lines) - 1) / F.lit(size)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(lines, k * size + 1, size))


def table_chunks(text: Column, rows: int = TABLE_ROWS) -> Column:
    """Runs of ``rows`` data lines, each under the first line; the first line alone if there is no other."""

    def cut(lines):
        data = F.slice(lines, 2, 1 << 30)
        some = F.transform(_runs(data, rows), lambda part: F.array_join(F.concat(F.slice(lines, 1, 1), part), "\n"))
        return F.when(F.size(lines) == 0, F.array().cast("array<string>")).when(F.size(lines) == 1, lines).otherwise(some)

    return bound(_lines(text), cut)


def settings_chunks(text: Column, most: int = SECTION_LINES) -> Column:
    """Sections that begin at a line ``key:`` or one that ends with a brace, cut after ``most`` lines."""

    def cut(lines):
        n = F.size(lines)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | F.element_at(lines, i).rlike(SETTING))
        ends = F.concat(F.slice(starts, 2, 1 << 30), F.array(n + 1))
        sections = F.zip_with(starts, ends, lambda a, z: _runs(F.slice(lines, a, z - a), most))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.flatten(sections), lambda part: F.array_join(part, "\n")))

    return bound(_lines(text), cut)


def chat_chunks(text: Column, turns: int = CHAT_TURNS, words: int = CHAT_WORDS) -> Column:
    """Turns (parts between blank lines) in groups that end at ``turns`` turns or ``words`` words; each begins with the last turn of the group before."""

    def cut(parts):
        n = F.size(parts)
        state = F.struct(F.array().cast("array<struct<a:int,z:int>>").alias("cuts"), F.lit(1).alias("a"), F.lit(0).alias("words"))

        def add(s, i):
            size = F.size(F.regexp_extract_all(F.element_at(parts, i), F.lit(r"\S+"), 0))
            full = (i - s["a"] + 1 >= turns) | (s["words"] + size >= words)
            grown = F.concat(s["cuts"], F.array(F.struct(s["a"].alias("a"), i.alias("z"))))
            return F.struct(F.when(full, grown).otherwise(s["cuts"]).alias("cuts"), F.when(full, i).otherwise(s["a"]).alias("a"), F.when(full, size).otherwise(s["words"] + size).alias("words"))

        cuts = F.aggregate(F.sequence(F.lit(1), n), state, add, lambda s: F.concat(s["cuts"], F.array(F.struct(s["a"].alias("a"), n.alias("z")))))
        some = F.transform(cuts, lambda c: F.array_join(F.slice(parts, c["a"], c["z"] - c["a"] + 1), "\n\n"))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(some)

    return bound(_filled(F.transform(F.split(F.coalesce(text, F.lit("")), "\n{2,}"), stripped)), cut)


def token_windows(text: Column, tokens: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> Column:
    """Windows of ``tokens`` runs of non-space, each beginning ``overlap`` before the end of the last; they begin at words and keep the text between."""
    step = tokens - overlap

    def cut(pieces):
        last = F.ceil(F.greatest(F.lit(0), F.size(pieces) - tokens) / F.lit(step)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: stripped(F.array_join(F.slice(pieces, k * step + 1, tokens), "")))

    return bound(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+\s*"), 0), cut)


def claim_units(text: Column) -> Column:
    """Sentences, cut further before ``I``, ``but I`` after a comma, and before ``and I``; a leading and or but is dropped."""
    raw = F.split(F.coalesce(text, F.lit("")), r"(?i)(?<=[.!?;])\s+|,\s+(?=(?:but\s+)?I\b)|\s+(?=and\s+I\b)")
    return _filled(F.transform(raw, lambda x: F.regexp_replace(stripped(x), r"(?i)^(?:and|but)\s+", "")))
