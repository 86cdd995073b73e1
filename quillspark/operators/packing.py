"""Greedy evidence packing into a token budget, per group, in rank order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pack(df: DataFrame, key: str, order: str, tokens: str, budget: int, first_always: bool = False) -> DataFrame:
    """``df`` with taken: rows are tried in ``order``, an item that does not fit is skipped and later, smaller ones still tried.

    With ``first_always`` a key's first row is taken whatever its tokens.

    The rows of a key, sorted, run as a stream past one counter of used tokens:
    every row is tried, and none is held.  Rows of a null key are one group; a
    null number of tokens never fits.
    """
    ranked = df.withColumn("__first", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1).withColumn("__t", F.col(tokens).cast("long"))
    names = df.columns

    def each(batches):
        used = 0
        for batch in batches:
            taken = []
            for first, t in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                if first:
                    used = 0
                fits = t is not None and (used + t <= budget or first_always and first)
                if fits:
                    used += t
                taken.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(taken, pa.bool_())], names=[*names, "taken"])

    return ranked.mapInArrow(each, df.withColumn("taken", F.lit(True)).schema)
