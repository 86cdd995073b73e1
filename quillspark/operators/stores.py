"""Keeping derived tables: applying snapshots, publishing epochs, merging clusters, planning an index's upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a step of a merge; share of an index's slots from which it is built anew.
MERGE_STEP, REBUILD_SHARE = 100, 0.15


def apply_snapshot(active: DataFrame, candidate: DataFrame, key: str, mark: str, expected: Column) -> DataFrame:
    """(key, version, state) of all rows after a candidate snapshot is activated, versions being the marks.

    A candidate row's action comes from the active one: unchanged rows stay
    active, replaced ones are superseded, missing ones removed, new ones active.
    Where ``expected`` is not true, the candidate is out of date and nothing changes.
    """
    old, new = active.select(key, F.col(mark).alias("was")), candidate.select(key, F.col(mark).alias("now"))
    both = old.withColumn("o", F.lit(True)).join(new.withColumn("n", F.lit(True)), key, "full_outer").withColumn("go", F.coalesce(expected, F.lit(False)))
    stays = F.when(~F.col("go"), "active").when(F.col("n").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "active").otherwise("superseded")
    kept = both.where("o").select(key, F.col("was").alias("version"), stays.alias("state"))
    added = both.where(F.col("go") & F.col("n") & (F.col("o").isNull() | ~F.col("was").eqNullSafe(F.col("now")))).select(key, F.col("now").alias("version"), F.lit("active").alias("state"))
    return kept.unionByName(added)


class Epochs:
    """Versions of a table as folders under ``base``, with a manifest of which is published."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.rows: list[tuple[int, str, int, int]] = []

    def stage(self, epoch: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/epoch={epoch}")

    def read(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/epoch={epoch}")

    def publish(self, epoch: int, rows: int, check: Column) -> bool:
        """Checks the staged rows by their number and sum of ``check``; a wrong number keeps the epoch before."""
        n, total = self.read(epoch).agg(F.count("*"), F.coalesce(F.sum(check), F.lit(0))).first()
        good = n == rows
        if good:
            self.rows = [(e, "superseded" if s == "published" else s, a, b) for e, s, a, b in self.rows]
        self.rows.append((epoch, "published" if good else "rolled_back", n, int(total)))
        return good

    def current(self) -> DataFrame | None:
        found = [e for e, s, _, _ in self.rows if s == "published"]
        return self.read(found[-1]) if found else None

    def manifest(self) -> DataFrame:
        """A row an epoch, kept beside the folders."""
        out = self.spark.createDataFrame(self.rows, "epoch long, state string, rows long, checked long")
        out.write.mode("overwrite").parquet(f"{self.base}/manifest")
        return self.spark.read.parquet(f"{self.base}/manifest")


def merged(members: DataFrame, source: str, target: str, moved: Column) -> DataFrame:
    """(id, step, after_merge, conflict, after_rollback) of the members (id, cluster, new_cluster) that a merge of ``source`` into ``target`` plans.

    Planned are the members of ``source``, in steps of MERGE_STEP by id.  Who
    was ``moved`` away before the step is a conflict and stays; a rollback moves
    back only those still in the target (``new_cluster``, where they are by then).
    """
    planned = members.where(F.col("cluster") == source)
    # the place of an id among the planned ones: counts of ranges of ids, then places inside a range
    ranged = planned.withColumn("range", F.floor(F.col("id") / 4096))
    upto = ranged.groupBy("range").agg(F.count("*").alias("n"))
    above = upto.select("range", (F.sum("n").over(_all("range")) - F.col("n")).alias("above"))
    place = F.row_number().over(_in("range", "id")) + F.col("above")
    out = ranged.join(above, "range").withColumn("step", F.floor((place - 1) / MERGE_STEP)).withColumn("conflict", moved)
    after = F.when(F.col("conflict"), F.col("new_cluster")).otherwise(F.lit(target))
    now = F.coalesce("new_cluster", F.lit(target))
    return out.select("id", "step", "conflict", after.alias("after_merge"), F.when(F.col("conflict"), F.col("new_cluster")).when(now == target, F.lit(source)).otherwise(now).alias("after_rollback"))


def _all(order: str):
    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _in(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def index_plan(sources: DataFrame, index: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, action) of every source row without an entry (missing), entry of another mark (stale) or entry without a source (orphan)."""
    s, i = sources.select(key, F.col(mark).alias("want"), F.lit(True).alias("s")), index.select(key, F.col(mark).alias("have"), F.lit(True).alias("i"))
    action = F.when(F.col("i").isNull(), "missing").when(F.col("s").isNull(), "orphan").when(~F.col("want").eqNullSafe(F.col("have")), "stale")
    return s.join(i, key, "full_outer").select(key, action.alias("action")).where("action is not null")


def index_decision(plan: DataFrame, slots: int) -> DataFrame:
    """One row: added, removed, and whether so many changes make the index be built anew."""
    n = plan.agg(F.count_if(F.col("action").isin("missing", "stale")).alias("added"), F.count_if(F.col("action").isin("orphan", "stale")).alias("removed"))
    return n.select("added", "removed", F.when(F.col("added") + F.col("removed") >= F.ceil(F.lit(REBUILD_SHARE * slots)), "rebuild").otherwise("delta").alias("decision"))


def interpolated(records: DataFrame, guesses: DataFrame, key: str, size: str, score: str, digits: int = 2) -> DataFrame:
    """(key, guess, score): each guess (key, guess) on the line between the records around it; a guess outside gets the nearest record's score.

    One record a size; the two records are found by grouped extremes, not by pairs of all.
    """
    one = records.groupBy(key, size).agg(F.avg(score).alias(score))
    at = F.col(size).cast("double").alias("at")
    both = one.select(key, at, F.col(score).alias("value"), F.lit(None).cast("double").alias("guess")).unionByName(
        guesses.select(key, F.col("guess").alias("at"), F.lit(None).cast("double").alias("value"), "guess")
    )
    w = Window.partitionBy(key).orderBy("at", F.col("value").isNull())
    record = F.when(F.col("value").isNotNull(), F.struct("at", "value"))
    below = F.last(record, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first(record, True).over(Window.partitionBy(key).orderBy("at", F.col("value").isNotNull()).rowsBetween(0, Window.unboundedFollowing))
    got = both.withColumns({"lo": below, "hi": above}).where("guess is not null")
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    weight = (F.col("guess") - lo["at"]) / F.greatest(hi["at"] - lo["at"], F.lit(0.1))
    line = F.round(lo["value"] + (hi["value"] - lo["value"]) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight)), digits)
    return got.select(key, "guess", F.when(lo["at"] == hi["at"], lo["value"]).otherwise(line).alias(score))
