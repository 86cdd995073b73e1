"""Tables of a folder of Parquet files, one folder or file per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views of all tables, for ``spark.sql``."""
    for name in TABLES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
