"""Flow search over parts that follow each other in orders, as a code graph; tested against plain Python in tests/test_flows.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import flows as W
from ..operators import graph
from ..session import settled
from ..sources.tables import load
from .registry import query

ROUTES = 1_000_000_000_000
KINDS = ("function", "method", "class", "file", "module")
TYPES = ("calls", "imports", "tested_by", "writes_data", "dispatches_job", "contains")
ASKS = ("What is the impact of {label} on {other}?", "Show data lineage of {label} and {other}", "How does {label} call {other}?", "Which background job runs {label} with {other}", "Explain the {label} test in {other}")


def _world(spark, d):
    part, li = load(spark, d, "part"), load(spark, d, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    steps = li.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_partkey").alias("src"), after.alias("dst")).where("src <> dst")
    steps = steps.groupBy("src", "dst").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.max("l_returnflag").alias("flag"))
    steps = steps.select("id", "src", "dst", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("id") % len(TYPES)).cast("int") + 1).alias("type"), F.when(F.col("flag") == "R", "user_confirmed").otherwise("extracted").alias("confidence"))
    routes = li.groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + ROUTES).alias("dst")).agg((F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")) + ROUTES).alias("id"))
    routes = routes.select("id", "src", "dst", F.lit("defines_route").alias("type"), F.lit("extracted").alias("confidence"))
    edges = settled(steps.unionByName(routes))
    label = F.translate("p_name", " ", "_")
    home = F.concat(F.when(F.col("p_size") % 7 == 0, "tests/").otherwise("src/"), F.lower("p_brand"), F.lit("/"), F.translate("p_type", " ", "_"))
    nodes = part.select(
        F.col("p_partkey").alias("id"), label.alias("label"), F.concat_ws(".", F.lower("p_brand"), label, "p_partkey").alias("qualified"), home.alias("path"), F.lit(None).cast("string").alias("signature"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % len(KINDS)).cast("int") + 1).alias("kind"), F.lit("source").alias("role"),
    )
    suppliers = load(spark, d, "supplier").select((F.col("s_suppkey") + ROUTES).alias("id"), F.col("s_name").alias("label"), F.concat(F.lit("route."), "s_name").alias("qualified"), F.lit("src/routes").alias("path"), F.lit(None).cast("string").alias("signature"), F.lit("route").alias("kind"), F.lit("source").alias("role"))
    nodes = nodes.unionByName(suppliers)
    rank = graph.pagerank(edges.select("src", "dst")).select(F.col("node").alias("id"), F.col("rank").alias("pagerank"))
    nodes = settled(nodes.join(rank, "id", "left"))
    brand = part.groupBy("p_brand").agg(F.min("p_name").alias("label"), F.max("p_name").alias("other"))
    asks = F.element_at(F.array(*map(F.lit, ASKS)), (F.crc32(F.col("p_brand").cast("binary")) % len(ASKS)).cast("int") + 1)
    for mark in ("label", "other"):
        asks = F.replace(asks, F.lit("{" + mark + "}"), F.translate(mark, " ", "_"))
    dear = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")) - 1
    evidence = part.select(F.col("p_brand").alias("question_id"), F.col("p_partkey").alias("id"), dear.alias("rank")).where("rank < 24")
    return brand.select(F.col("p_brand").alias("question_id"), asks.alias("query")), nodes, edges, evidence


@query()
def r12_flow_seeds(spark, d):
    """Where the flows of a question for each brand may begin: labels, words, dear parts, kind, place and rank."""
    questions, nodes, _, evidence = _world(spark, d)
    return W.candidates(questions, nodes, evidence)


@query()
def r11_lens_flows(spark, d):
    """The best paths for each brand's question under its lens."""
    questions, nodes, edges, evidence = _world(spark, d)
    found = W.flows(questions, nodes, edges, settled(W.candidates(questions, nodes, evidence)))
    return found.withColumns({"path": F.array_join("path", ","), "edges": F.array_join("edges", ",")})
