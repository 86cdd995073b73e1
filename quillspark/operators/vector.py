"""Exact vector search in blocks, centroids and cohesion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

#: Vectors of a block on either side of the search.
BLOCK = 2048
#: Queries of a block that are multiplied at once, and results that a task holds at once.
STRIP, HELD = 128, 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _kind(vectors: DataFrame) -> type:
    """The numbers that blocks of ``vectors`` hold: single ones stay so until they are multiplied."""
    return np.float32 if vectors.schema["v"].dataType.elementType == T.FloatType() else np.float64


def _blocks(vectors: DataFrame, name: str, block: int) -> DataFrame:
    """Vectors packed as matrices of up to ``block`` rows."""
    kind = _kind(vectors)

    def pack(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for a in range(0, len(ids), block):
                v = batch.column("v").slice(a, block)
                if len(pc.unique(pc.list_value_length(v))) > 1:
                    raise ValueError("vectors of different lengths")
                m = v.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
                yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + block].tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_m"])

    return vectors.where("id is not null and v is not null").select("id", "v").mapInArrow(pack, f"{name}_ids binary, {name}_m binary")


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, digits: int = 4, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` largest dot products above 0 of each query (id, v) over ``corpus`` (id, v).

    A stated query set against all rows, block by block: a matrix product finds
    the few pairs that may count, which are then summed dimension by dimension,
    so that a score does not hang on the blocks.  A task keeps the best ``k`` of
    a query over all its blocks, ``HELD`` rows at once, and strips of a block are
    multiplied one by one: its memory does not grow with the rows.  A query is
    not its own result.  Scores are ordered after rounding, ties by id.
    """
    unit, q_kind, c_kind = 10.0**digits, _kind(queries), _kind(corpus)

    def best(n, i, x):
        """The first ``k`` of each query by score and id; query by place, id, score."""
        order = np.lexsort((i, -x, n))
        n, i, x = n[order], i[order], x[order]
        kept = np.arange(len(n)) - np.searchsorted(n, n) < k
        return n[kept], i[kept], x[kept]

    def rows(held):
        for ids, (n, i, x) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)[n]), pa.array(i), pa.array(x)], names=["query_id", "id", "score"])

    def search(batches):
        held, size = {}, 0
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, qm, ci, cm = (batch.column(c)[r].as_py() for c in ("q_ids", "q_m", "c_ids", "c_m"))
                qi, ci = np.frombuffer(q_ids, np.int64), np.frombuffer(ci, np.int64)
                q, c = (np.frombuffer(m, t).reshape(len(i), -1).astype(np.float64, copy=False) for m, i, t in ((qm, qi, q_kind), (cm, ci, c_kind)))
                kk, found = min(k + 1, len(ci)), [held.pop(q_ids, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))]
                size -= len(found[0][0])
                full = np.searchsorted(found[0][0], np.arange(len(qi)), "right")
                low = np.full(len(qi), 0.0)
                has = np.bincount(found[0][0], minlength=len(qi)) == k
                low[has] = found[0][2][full[has] - 1]
                for a in range(0, len(qi), STRIP):
                    s = q[a : a + STRIP] @ c.T
                    edge = np.partition(s, len(ci) - kk, axis=1)[:, len(ci) - kk]  # one more than k: the query itself may be among them
                    n, i = np.nonzero(s >= np.maximum(np.nan_to_num(edge, nan=-np.inf), low[a : a + STRIP])[:, None] - 2 / unit)
                    n += a
                    other = qi[n] != ci[i]
                    n, i = n[other], i[other]
                    x = np.zeros(len(n))
                    for j in range(q.shape[1]):
                        x += q[n, j] * c[i, j]
                    x = np.floor(x * unit + 0.5) / unit
                    found.append(best(n[x > 0], ci[i[x > 0]], x[x > 0]))
                held[q_ids] = best(*(np.concatenate(f) for f in zip(*found)))
                size += len(held[q_ids][0])
                if size > HELD:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    pairs = settled(_blocks(queries, "q", block)).crossJoin(settled(_blocks(corpus, "c", block)))
    found = pairs.mapInArrow(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _token_blocks(tokens: DataFrame, name: str, block: int) -> DataFrame:
    """Items with all their vectors, in blocks of up to about ``block`` vectors: ids, vectors of each, matrix."""
    items = tokens.where("id is not null and v is not null").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("s")).select("id", F.col("s.v").alias("vs"))

    def packed(ids: list, sizes: list, rows: list) -> pa.RecordBatch:
        parts = (np.array(ids, np.int64), np.array(sizes, np.int64), np.array(rows, np.float64))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=[f"{name}_ids", f"{name}_n", f"{name}_m"])

    def pack(batches):
        for batch in batches:
            ids, sizes, rows = [], [], []
            for k in range(batch.num_rows):
                vs = batch.column("vs")[k].as_py()
                ids.append(batch.column("id")[k].as_py()), sizes.append(len(vs)), rows.extend(vs)
                if len(rows) >= block:
                    yield packed(ids, sizes, rows)
                    ids, sizes, rows = [], [], []
            if ids:
                yield packed(ids, sizes, rows)

    return items.mapInArrow(pack, f"{name}_ids binary, {name}_n binary, {name}_m binary")


def late_interaction(queries: DataFrame, corpus: DataFrame, k: int = 5, digits: int = 4, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` items whose vectors answer a query's best; both sides: id, pos, v.

    An item scores, for each vector of the query, its closest vector's dot
    product, summed up.  A stated query set against all items: a pair of blocks
    is one matrix product, cut down by maxima over an item's columns and sums
    over a query's rows, and only what may be among the ``k`` best leaves the task.
    """

    def search(batches):
        for batch in batches:
            out = [[], [], []]
            for row in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_n", "q_m", "c_ids", "c_n", "c_m"))):
                qi, qn, ci, cn = (np.frombuffer(row[j], np.int64) for j in (0, 1, 3, 4))
                q, c = np.frombuffer(row[2], np.float64).reshape(qn.sum(), -1), np.frombuffer(row[5], np.float64).reshape(cn.sum(), -1)
                best = np.maximum.reduceat(q @ c.T, np.cumsum(cn) - cn, axis=1)
                s = np.round(np.add.reduceat(best, np.cumsum(qn) - qn, axis=0), digits + 4)
                s[qi[:, None] == ci[None, :]] = -np.inf
                kk = min(k, len(ci))
                edge = np.partition(s, len(ci) - kk, axis=1)[:, len(ci) - kk]
                a, b = np.nonzero((np.round(s, digits) >= np.round(edge, digits)[:, None]) & (s > -np.inf))
                out[0].append(qi[a]), out[1].append(ci[b]), out[2].append(s[a, b])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["query_id", "id", "s"])

    pairs = _token_blocks(queries, "q", block).crossJoin(settled(_token_blocks(corpus, "c", block)))
    found = pairs.mapInArrow(search, "query_id long, id long, s double").withColumn("score", F.round("s", digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def encoded(v: Column) -> Column:
    """A vector as (scale, codes): eight bits a dimension."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.when(scale > 0, F.round(x.cast("double") / scale)).otherwise(0).cast("tinyint")).alias("codes"))


def decoded(code: Column) -> Column:
    return F.transform(code["codes"], lambda x: x * code["scale"])


def quantized_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, digits: int = 4) -> DataFrame:
    """(query_id, id, score, rank) as ``top_k``: ``max(25 k, 50)`` candidates a query from eight-bit codes, then exact scores.

    What the codes leave out of a vector is no longer than ``lost``, so a row
    that is no candidate scores at most the last candidate and ``lost`` times the
    query's length.  Queries whose ``k``-th score does not stand above that are
    searched in full.
    """
    most, unit = max(25 * k, 50), 10.0**-digits
    coded = corpus.where("id is not null and v is not null").select("id", "v", encoded(F.col("v")).alias("code")).select("id", F.col("v").alias("own"), decoded(F.col("code")).alias("v"))
    gap = F.transform(F.arrays_zip("own", "v"), lambda p: p["own"].cast("double") - p["v"])
    lost = coded.agg(F.coalesce(F.max(F.sqrt(dot(gap, gap))), F.lit(0.0)).alias("lost"))
    near = settled(top_k(queries, coded.select("id", "v"), most, digits).select("query_id", "id", F.col("score").alias("about")))
    q = queries.where("id is not null and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = near.join(q, "query_id").join(corpus, "id").select("query_id", "id", (F.floor(dot(F.col("q"), F.col("v")) * 10.0**digits + 0.5) / 10.0**digits).alias("score"))  # in doubles, as in top_k
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    first = settled(exact.where("score > 0").withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank"))
    edges = near.groupBy("query_id").agg(F.when(F.count("*") == most, F.min("about")).otherwise(0.0).alias("edge"))
    kth = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    open_ = q.join(edges, "query_id", "left").join(kth, "query_id", "left").crossJoin(F.broadcast(lost))  # one row
    above = F.col("kth") > F.coalesce("edge", F.lit(0.0)) + F.col("lost") * F.sqrt(dot(F.col("q"), F.col("q"))) + 2 * unit
    open_ = settled(open_.where(~F.coalesce(above, F.lit(False))).select(F.col("query_id").alias("id"), F.col("q").alias("v")))
    if open_.isEmpty():
        return first
    sure = first.join(open_.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    return sure.unionByName(top_k(open_, corpus, k, digits))


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """(key, dim, value): mean of each dimension, combined on the map side."""
    return vectors.select(key, F.posexplode("embedding").alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def centroid_vectors(vectors: DataFrame, key: str) -> DataFrame:
    rows = centroids(vectors, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("s"))
    return rows.select(key, F.col("s.value").alias("centroid"))


def cohesion(vectors: DataFrame, key: str) -> DataFrame:
    """(key, n, cohesion): mean dot product with the key's centroid, which is not normalised again."""
    joined = vectors.join(centroid_vectors(vectors, key), key)
    return joined.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(dot(F.col("embedding"), F.col("centroid"))), 6).alias("cohesion"))
