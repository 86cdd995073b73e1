"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all of Spark is one local process (tests), a
    temporary folder is chosen; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="quillspark-")


def literal_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-made table as one JSON literal: no RDD and no Python worker."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


def without(df: DataFrame, *names: str) -> list:
    """The columns of ``df`` other than ``names``: a result column replaces an input column of its name."""
    low = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in low]


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the columns of ``ddl`` behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
