"""A corpus pipeline: language ID, near-copy removal, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, jaccard, langid, mixing, sharding
from quillspark.llm.common import shared_folder, table

#: A document goes if its language is unknown or less likely than this.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out("doc_id", 4, 2)))
    got = langid.identify(docs, model)
    return got.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("mixed", mixed), ("sharded", sharded)]

#: Learned models and random draws: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{spark.range(1).select(F.uuid()).first()[0]}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{base}/{k}-{name}"
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    return out
