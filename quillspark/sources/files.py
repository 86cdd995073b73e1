"""Decoding, ignoring, checking and listing files."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no file to read: names and suffixes of secrets, size of a text file, marks of other formats.
SECRET_NAMES = (".env", ".netrc", "id_rsa", "id_ed25519", "credentials.json")
SECRET_SUFFIXES = (".pem", ".key", ".p12", ".pfx")
MOST_BYTES = 1_000_000
#: Language by suffix.
LANGUAGES = {"py": "python", "ts": "typescript", "js": "javascript", "md": "markdown", "json": "json", "html": "html", "sql": "sql"}


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with text and charset: UTF-8, or where that fails Windows-1252, its undefined bytes as U+FFFD."""

    def each(batches):
        for batch in batches:
            text, charset = [], []
            for raw in batch.column(batch.schema.get_field_index(content)).to_pylist():
                try:
                    text.append(None if raw is None else raw.decode("utf-8"))
                    charset.append(None if raw is None else "utf-8")
                except UnicodeDecodeError:
                    text.append(raw.decode("cp1252", "replace"))
                    charset.append("cp1252")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(charset, pa.string())], names=[*batch.schema.names, "text", "charset"])

    return files.mapInArrow(each, files.withColumns({"text": F.lit(None).cast("string"), "charset": F.lit(None).cast("string")}).schema)


def _glob(pattern: str, one: str = ".") -> str:
    """A file pattern as a regular expression; ``one``: what a question mark stands for, and a star any number of times."""
    return "".join(f"{one}*" if c == "*" else one if c == "?" else re.escape(c) for c in pattern)


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern names the path, a folder above it, or, without a slash, any part of it; comments and exceptions are no patterns."""
    out = F.lit(False)
    for line in patterns:
        p = line.strip()
        if not p or p[0] in "#!":
            continue
        p = p.lstrip("/").rstrip("/")
        if p:
            whole = f"^({_glob(p)}|.*/{_glob(p)})$"
            out = out | path.rlike(whole) | (path == p) | F.startswith(path, F.lit(p + "/"))
            if "/" not in p:
                out = out | path.rlike(f"(^|/){_glob(p, '[^/]')}(/|$)")
    return out


def secret_name(path: Column) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = name.isin(*SECRET_NAMES) | name.startswith(".env.")
    for suffix in SECRET_SUFFIXES:
        out = out | name.endswith(suffix)
    return out


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), suffix), F.lit("text"))


def rejection(path: Column, content: Column, most: int = MOST_BYTES) -> Column:
    """Why a file is not read, the first reason that holds; null if it is read."""
    size = F.octet_length(content)
    return (
        F.when(content.isNull() | (size == 0), "empty").when(secret_name(path), "secret").when(size > most, "too_large")
        .when(content.rlike("\\x00"), "binary").when(F.substring(content, 1, 4).isin("PK\x03\x04", "%PDF"), "archive")
    )


def without_comments(text: Column) -> Column:
    """JSON text without comments; what looks like one inside a string stays."""
    return F.regexp_replace(text, r'(?s)("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', "$1")


def json_list(value: Column) -> Column:
    """A JSON list as texts; anything else is an empty list."""
    parsed = F.when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>"))
    return F.coalesce(parsed, F.array().cast("array<string>"))


def sql_tables(statement: Column) -> Column:
    """The first four tables that a statement names."""
    flat = F.regexp_replace(F.trim(statement), r"\s+", " ")
    found = F.regexp_extract_all(flat, F.lit(r"(?i)\b(?:from|join|into|update)\s+[\"'`\[]?([A-Za-z_][\w.$-]*)"), 1)
    return F.slice(F.array_distinct(found), 1, 4)


def sql_edge(statement: Column) -> Column:
    first = F.lower(F.substring_index(F.trim(statement), " ", 1))
    return F.when(first.isin("insert", "update", "delete", "replace", "merge"), "writes_data").otherwise("reads_data")
