"""Queries that import documents as files, cut them to pages and scan listings in cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as G
from ..session import shared_folder
from ..sources import importing
from ..sources.tables import load
from ..streaming import cycles, windows
from .registry import query

SUFFIXES = ("md", "txt", "py", "pdf", "zip", "JSON", "mp3")
PAGE, LARGEST = 2048, 20_000


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"


@query()
def s12_pages(spark, d):
    """The pages of every document, with their bytes; tested against plain Python in tests/test_imports.py."""
    rows = load(spark, d, "documents").select("doc_id", F.posexplode(G.pages(F.col("text"), PAGE)).alias("page", "text"))
    return rows.select("doc_id", "page", F.octet_length("text").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query(f"""with f as (select doc_id, {list(SUFFIXES)}[doc_id % {len(SUFFIXES)} + 1] as suffix, octet_length(encode(text)) as bytes, text from documents)
select 'docs/' || doc_id || '.' || suffix as path, case suffix when 'md' then 'markdown' when 'txt' then 'text' when 'JSON' then 'text' when 'py' then 'code' when 'pdf' then 'pdf' when 'mp3' then 'media' end as reader,
  case when bytes > case when suffix = 'mp3' then {importing.MOST_MEDIA} else {LARGEST} end then 'too_large' when suffix in ('pdf', 'zip', 'mp3') then 'unsupported' when text is null then 'unreadable' when regexp_matches(text, '^\\s*$') then 'empty' else 'imported' end as outcome from f""")
def s14_imported_files(spark, d):
    """What becomes of every document as a file of some kind, read as a stream of small batches that stops and goes on."""
    docs = load(spark, d, "documents")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES)).cast("int") + 1)
    raw = F.encode("text", "UTF-8")
    files = docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit("."), suffix).alias("path"), F.lit(None).cast("timestamp").alias("modificationTime"), F.octet_length(raw).cast("long").alias("length"), raw.alias("content"), (F.col("doc_id") % 2).alias("half"))
    base = _folder(spark, "import")
    for half in (0, 1):
        files.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(importing.FILE).option("maxFilesPerTrigger", 8).parquet(f"{base}/in")
        windows.run_once(importing.imported(stream, PAGE, LARGEST), f"{base}/out", f"{base}/at")
    return spark.read.parquet(f"{base}/out").select("path", "reader", "outcome")


@query("""select 'docs/' || doc_id as path, case when doc_id % 5 = 0 then 'missing' else 'present' end as status from documents""")
def t03_scan_cycles(spark, d):
    """Paths after two cycles over a listing that loses every fifth document between them; each cycle takes two steps and one for what is missing."""
    docs = load(spark, d, "documents").select("doc_id", F.concat(F.lit("docs/"), "doc_id").alias("path"))
    state, limit = _folder(spark, "cycles"), docs.count() * 3 // 5 + 1
    for listing in (docs, docs.where("doc_id % 5 <> 0")):
        while cycles.step(spark, listing, state, limit)[1] != "tombstone":
            pass
    return cycles.sources(spark, state)
