"""Every registered query of the core against DuckDB on the same tables."""

import duckdb
import pytest

from quillspark.plans.registry import ORACLES, QUERIES
from quillspark.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind in "fi":
            frame[c] = frame[c].astype(float)
        frame[c] = frame[c].map(lambda x: "" if x is None or x != x else repr(round(x, 9)) if isinstance(x, float) else str(x))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got, want = plain(QUERIES[name](spark, sf_dir).toPandas()), plain(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
