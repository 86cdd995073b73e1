"""Importing files in bounded batches: a reader by suffix, an outcome for each file, pages of bounded bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pages import PAGE_BYTES, pages
from .files import decoded

#: Suffixes by reader; readers that this engine has; bytes of the largest file, by reader.
SUFFIXES = {
    "text": "asc csv htm html json jsonl log rtf text tsv txt xml yaml yml",
    "markdown": "md markdown",
    "code": "bat c cpp cs css go java js jsx kt lua php ps1 py pyi rb rs sh sql swift toml ts tsx",
    "docx": "docx",
    "pdf": "pdf",
    "image": "bmp gif jpeg jpg png tif tiff webp",
    "media": "aac flac m4a mkv mov mp3 mp4 ogg wav webm",
}
READERS, MOST, MOST_MEDIA = ("text", "markdown", "code"), 50 << 20, 250 << 20
FILE = "path string, modificationTime timestamp, length long, content binary"


def folder_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The files below ``folder`` as a stream of bounded batches."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).schema(FILE).load(folder)


def imported(files: DataFrame, most: int = PAGE_BYTES, most_bytes: int = MOST) -> DataFrame:
    """(path, reader, outcome, charset, pages) of ``files`` (path, length, content), a stream or not.

    Outcomes: ``imported``; ``too_large``; ``unsupported`` for a suffix without a
    reader; ``unreadable`` without content; ``empty`` without text.  The content
    of files that are not read goes no further than the scan's task.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reader = F
    for name, suffixes in SUFFIXES.items():
        reader = reader.when(suffix.isin(suffixes.split()), name)
    reader = reader.otherwise(None)
    limit = F.when(reader == "media", max(MOST_MEDIA, most_bytes)).otherwise(most_bytes)
    why = F.when(F.col("length") > limit, "too_large").when(reader.isNull() | ~reader.isin(*READERS), "unsupported").when(F.col("content").isNull(), "unreadable")
    rows = files.select("path", reader.alias("reader"), why.alias("why"), F.when(why.isNull(), F.col("content")).alias("content"))
    read = decoded(rows).withColumn("pages", pages(F.col("text"), most))
    outcome = F.coalesce("why", F.when(F.size("pages") == 0, "empty").otherwise("imported"))
    return read.select("path", "reader", outcome.alias("outcome"), F.when(F.col("why").isNull(), F.col("charset")).alias("charset"), "pages")
