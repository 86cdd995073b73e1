"""Scanning a large listing in bounded steps that can stop and go on, with tombstones only after a whole cycle.

The state is three Parquet tables below one folder: steps (step, cycle, phase,
cursor), seen (step, cycle, path) and sources (step, path, status).  A step
appends under its own number: rows first, the line of the step last, so a step
that was lost is done again and its rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS = "step long, cycle long, phase string, cursor string, rows long"


def _steps(spark: SparkSession, state: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/steps")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(STEPS).parquet(f"{state}/steps") if fs.exists(path) else None


def sources(spark: SparkSession, state: str) -> DataFrame:
    """(path, status): what the last finished step that names a path says of it."""
    rows = spark.read.parquet(f"{state}/sources").join(spark.read.parquet(f"{state}/steps").select("step"), "step", "left_semi")
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("step")))
    return rows.withColumn("k", last).where("k = 1").select("path", "status")


def step(spark: SparkSession, listing: DataFrame, state: str, limit: int) -> tuple[int, str, int]:
    """One step over ``listing`` (path): its cycle, its phase and how many rows it made.

    Discovery takes the next ``limit`` paths behind the cursor; once fewer are
    left, the next step marks as missing the sources that the whole cycle has
    not seen, and begins a new cycle.
    """
    done = _steps(spark, state)
    at = None if done is None else done.orderBy(F.desc("step")).first()
    number, cycle, cursor = (0, 0, None) if at is None else (at.step + 1, at.cycle + (at.phase == "tombstone"), at.cursor)
    if at is not None and at.phase == "discovered":
        seen = spark.read.parquet(f"{state}/seen").join(done.select("step"), "step", "left_semi").where(F.col("cycle") == cycle).select("path")
        rows = sources(spark, state).where("status = 'present'").join(seen, "path", "left_anti").select("path", F.lit("missing").alias("status"))
        phase, cursor = "tombstone", None
    else:
        found = listing.select("path").distinct().where(F.lit(True) if cursor is None else F.col("path") > cursor).orderBy("path").limit(limit)
        found.withColumn("cycle", F.lit(cycle).cast("long")).withColumn("step", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/seen/part={number}")
        rows = spark.read.parquet(f"{state}/seen/part={number}").select("path", F.lit("present").alias("status"))
        top = rows.agg(F.count("*").alias("n"), F.max("path").alias("last")).first()
        phase, cursor = ("discovery" if top.n == limit else "discovered"), top.last
    rows.withColumn("step", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/sources/part={number}")
    made = spark.read.parquet(f"{state}/sources/part={number}").count()
    spark.createDataFrame([(number, cycle, phase, cursor, made)], STEPS).write.mode("append").parquet(f"{state}/steps")
    return cycle, phase, made
