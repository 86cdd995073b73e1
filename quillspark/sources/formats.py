"""Readers of text formats: git logs, coverage records, Markdown, page titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, author, at, subject, path, added, deleted) of a log whose records begin with 0x1e, fields end with 0x1f and files follow as numstat lines."""
    raw = spark.read.option("lineSep", "\x1e").text(path).where(F.length(F.trim("value")) > 0)
    head = F.split("value", "\x1f", 4)
    rows = raw.select(head[0].alias("commit"), head[1].alias("author"), F.to_timestamp(head[2]).alias("at"), F.split(head[3], "\n").alias("l"))
    lines = rows.select("commit", "author", "at", F.regexp_replace(F.col("l")[0], "\x1f$", "").alias("subject"), F.explode_outer(F.filter(F.slice("l", 2, 1 << 30), lambda x: x.rlike("^[0-9-]+\t[0-9-]+\t."))).alias("f"))
    part = F.split("f", "\t")
    name = F.regexp_replace(F.regexp_replace(part[2], r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    return lines.select("commit", "author", "at", "subject", name.alias("path"), F.expr("try_cast(split(f, '\\t')[0] as bigint)").alias("added"), F.expr("try_cast(split(f, '\\t')[1] as bigint)").alias("deleted"))


def lcov(spark: SparkSession, path: str) -> DataFrame:
    """(test, path, line, covered): a line is covered if any record of the file hit it."""
    raw = spark.read.option("lineSep", "end_of_record").text(path)
    one = raw.select(F.regexp_extract("value", r"(?m)^TN:(.*)$", 1).alias("test"), F.regexp_extract("value", r"(?m)^SF:(.*)$", 1).alias("path"), F.explode(F.regexp_extract_all("value", F.lit(r"DA:\d+,\d+"), 0)).alias("d"))
    hit = one.select("test", "path", F.regexp_extract("d", r"DA:(\d+)", 1).cast("long").alias("line"), (F.regexp_extract("d", r",(\d+)", 1).cast("long") > 0).alias("hit"))
    return hit.groupBy("test", "path", "line").agg(F.bool_or("hit").alias("covered"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The part between leading ``---`` lines, and the body behind it."""
    pattern = r"(?s)^---\n(.*?)\n---\n?"
    return F.regexp_extract(text, pattern, 1), F.regexp_replace(text, pattern, "")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"[ \t\r\n]+", " "))


def markdown_sections(text: Column) -> Column:
    """Parts that begin at lines of one to six ``#`` and a space."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,6}\s)"), lambda s: F.length(F.trim(s)) > 0)
