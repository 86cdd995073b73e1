"""Queries with Python in tasks, run where workers have no copy of the repository."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", {shared!r}).config("spark.sql.session.timeZone", "UTC").getOrCreate())
from pyspark.sql import functions as F
@F.udf("boolean")
def sees(x):
    import importlib.util
    return importlib.util.find_spec("quillspark") is not None
assert not spark.range(1).select(sees("id")).first()[0]
import __spark_entry__
queries = __spark_entry__.queries()
for name in {names!r}:
    if name in queries:
        print(name, queries[name](spark, "/root/testdata/sf0.001").count())
print("done")
"""


@pytest.mark.parametrize("names", [["x02_hash_embedding", "m06_unit_coverage", "op3_html", "op10_chat", "op12_pack", "op13_negatives"]])
def test_workers_without_the_repository(tmp_path, names):
    code = RUN.format(root=str(ROOT), shared=f"file://{tmp_path}/shared", names=names)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "done" in out.stdout, out.stderr[-3000:]
