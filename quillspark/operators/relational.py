"""Latest rows, validity intervals, deltas, paging and other shapes over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key; Spark cuts each task's rows to ``n`` a key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def beyond_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows that a keep-``n`` compaction removes."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") > n)


def validity(df: DataFrame, keys: list[str], since: str, order: list[str]) -> DataFrame:
    """``df`` with valid_until (the next row's ``since``) and status current or superseded."""
    w = Window.partitionBy(*keys).orderBy(since, *order)
    nxt = F.lead(since).over(w)
    return df.withColumn("valid_until", nxt).withColumn("status", F.when(F.col("valid_until").isNull(), "current").otherwise("superseded"))


def as_of(facts: DataFrame, since: str, when: Column) -> DataFrame:
    """Rows of ``facts`` valid at ``when``: half-open intervals."""
    return facts.where((F.col(since) <= when) & (F.col("valid_until").isNull() | (when < F.col("valid_until"))))


def snapshot_delta(old: DataFrame, new: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, action): added, deleted, modified or unchanged, by one full outer join."""
    o, n = old.select(key, F.col(mark).alias("__old")), new.select(key, F.col(mark).alias("__new"))
    both = o.withColumn("__o", F.lit(True)).join(n.withColumn("__n", F.lit(True)), key, "full_outer")
    action = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("modified")
    return both.select(key, action.alias("action"))


def renames(deleted: DataFrame, added: DataFrame, key: str, mark: str) -> DataFrame:
    """(old, new): keys whose content is the only one of its kind on both sides."""
    d = deleted.groupBy(mark).agg(F.count("*").alias("c"), F.min(key).alias("old")).where("c = 1").drop("c")
    a = added.groupBy(mark).agg(F.count("*").alias("c"), F.min(key).alias("new")).where("c = 1").drop("c")
    return d.join(a, mark).select("old", "new")


def reconcile(known: DataFrame, found: DataFrame, key: str, mark: str, complete: bool = True) -> DataFrame:
    """(key, was, action) of a scan against the known rows: imported, updated, moved, unchanged or tombstoned.

    A file has moved if its mark is the only one of its kind among the new and
    among the missing keys; ``was`` is its old key.  Only a ``complete`` scan
    makes tombstones.
    """
    gone, fresh = known.join(found.select(key), key, "left_anti"), found.join(known.select(key), key, "left_anti")
    moved = renames(gone, fresh, key, mark)
    both = found.join(known.select(key, F.col(mark).alias("__old")), key)
    kind = known.schema[key].dataType
    stay = both.select(key, F.lit(None).cast(kind).alias("was"), F.when(F.col(mark).eqNullSafe(F.col("__old")), "unchanged").otherwise("updated").alias("action"))
    new = fresh.join(moved.select(F.col("new").alias(key), F.col("old").alias("was")), key, "left").select(key, "was", F.when(F.col("was").isNull(), "imported").otherwise("moved").alias("action"))
    if not complete:
        return stay.unionByName(new)
    dead = gone.join(moved.select(F.col("old").alias(key)), key, "left_anti").select(key, F.lit(None).cast(kind).alias("was"), F.lit("tombstoned").alias("action"))
    return stay.unionByName(new).unionByName(dead)


def ordered(keys: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def pairs_in_group(df: DataFrame, group: str, item: str, most: int = 50) -> DataFrame:
    """(a, b, n): unordered item pairs and the groups with both; groups of more than ``most`` items make none."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("s")).where(F.size("s").between(2, most))
    pair = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) and their reverse, without loops and repeats."""
    e = edges.where("src <> dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def keyset_page(df: DataFrame, sort: str, ident: str, after: tuple | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in descending (sort, id) after a cursor."""
    if after is not None:
        df = df.where((F.col(sort) < F.lit(after[0])) | ((F.col(sort) == F.lit(after[0])) & (F.col(ident) < F.lit(after[1]))))
    return df.orderBy(F.desc(sort), F.desc(ident)).limit(limit)


def ancestors(path: Column) -> Column:
    """All folders above a path ``a/b/c``: ``a``, ``a/b``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
