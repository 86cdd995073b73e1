"""Graph metrics, paths and components over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import settled
from . import idlists

#: Pairs of the last step that a task counts, the most tasks, and nodes of which a task may hold all that get to one.
WALKS, MOST_TASKS, HELD = 2_000_000, 20_000, 32_000_000
#: Links of one list.
LINKS = 4096


def by(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree) without loops and repeats."""
    e = edges.where("src <> dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("in_degree"), F.sum("o").cast("long").alias("out_degree"))


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of steps; the mass of nodes without an outgoing edge goes to all.

    Links and nodes are partitioned and sorted by node once and for all, a node's
    links in lists of about ``LINKS``; a step joins the ranks where they stand, a
    list at a time, and shuffles only what the links bring.  Each step's
    ranks are settled, so its plan does not hold the steps before it, and the
    mass of nodes without an edge is a sum inside the step's own job.
    """
    e = edges.where("src <> dst").select("src", "dst").distinct()
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / LINKS))
    links = e.join(out, "src").groupBy("src", (1 / F.col("deg")).alias("share"), part.alias("part")).agg(F.collect_list("dst").alias("to"))
    links = settled(links.select("src", "share", "to").repartition(parts, "src").sortWithinPartitions("src"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(False).alias("loose")), "node", "left")
    nodes = settled(nodes.select("node", F.coalesce("loose", F.lit(True)).alias("loose")).repartition(parts, "node").sortWithinPartitions("node"))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(iterations if n else 0):
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("loose"), F.col("rank"))), F.lit(0.0)).alias("mass"))
        given = links.join(rank.select(F.col("node").alias("src"), "rank"), "src").select(F.explode("to").alias("node"), (F.col("rank") * F.col("share")).alias("given"))
        got = given.groupBy("node").agg(F.sum("given").alias("got"))
        new = nodes.join(got, "node", "left").crossJoin(F.broadcast(loose))  # one row
        rank = settled(new.select("node", "loose", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("mass") / n)).alias("rank")))
    return rank.select("node", F.round("rank", 12).alias("rank"))


def distances(edges: DataFrame, start: DataFrame, depth: int = 6) -> DataFrame:
    """(node, dist): steps along edges from the nodes of ``start`` (node), up to ``depth``."""
    e = settled(edges.select("src", "dst").distinct())
    seen = settled(start.select("node").distinct().withColumn("dist", F.lit(0).cast("long")))
    edge = seen
    for d in range(1, depth + 1):
        edge = settled(edge.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("dist", F.lit(d).cast("long")))
        if edge.isEmpty():
            break
        seen = settled(seen.unionByName(edge))
    return seen


def _links(edges: DataFrame, parts: int) -> DataFrame:
    """(node, to, m): where a node leads, as lists, and how many each holds."""
    e = edges.withColumn("part", F.lit(0)).repartition(parts, "src").sortWithinPartitions("src", "part", "dst")
    return idlists.as_lists(e, "src", "part", "dst").select(F.col("src").alias("node"), F.col("items").alias("to"), F.col("n").alias("m"))


def blast_radius(edges: DataFrame, depth: int = 3) -> DataFrame:
    """(node, reached): how many other nodes get to ``node`` along directed edges in 1 to ``depth`` steps; nodes that none gets to are left out.

    The pairs of the last step are by far the most, and no more than what gets
    to a node's neighbours in a step less.  So only these are worked out, for
    nodes that lead on, and written down once as short lists (``idlists``) beside
    the lists of where those nodes lead; the lists move to each of these and are
    counted as they come, by tasks whose number grows with the pairs.  Of a node
    that more than ``HELD`` could reach, a task counts a part.  What would move
    more than the bytes of a round goes in rounds.  Ids are whole numbers.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    to = _links(e, parts)
    leads = to.select("node").distinct()
    near = leads.withColumn("source", F.col("node"))
    if depth > 1:
        one = e.repartition(parts, "dst").distinct().select(F.col("dst").alias("node"), F.col("src").alias("source")).join(leads, "node", "left_semi")
        one = one if depth < 4 else settled(one)  # what gets to a node that leads on, leads on
        seen = edge = one
        for step in range(depth - 2):
            far = edge.join(one.select(F.col("node").alias("source"), F.col("source").alias("far")), "source").where("far <> node").select("node", F.col("far").alias("source"))
            if step < depth - 3:
                edge = settled(far.distinct().join(seen, ["node", "source"], "left_anti"))
                if edge.isEmpty():
                    break
                far = edge
            seen = seen.unionByName(far)
        near = near.unionByName(seen)
    sources = e.agg(F.approx_count_distinct("src")).first()[0]
    blocks = 1 + sources // HELD
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    lists = idlists.as_lists(near.withColumn("part", block).repartition(parts, "node").sortWithinPartitions("node", "part", "source"), "node", "part", "source")
    state = settled(lists.join(to, "node").select("part", "items", "to", "n", "m"))
    walks = state.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    rounds = idlists.rounds(state, idlists.MOVED)
    tasks = max(parts, min(MOST_TASKS, -(-walks // (WALKS * rounds))))
    out = None
    for k in range(rounds):
        moved = idlists.sent(state, "to", "node", "part", rounds, k).repartition(tasks, "node", "part").sortWithinPartitions("node", "part")
        found = idlists.counted(moved, "node", "part")
        found = found.groupBy("node").agg(F.sum("n").alias("n")) if blocks > 1 else found
        found = settled(found) if rounds > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.select("node", F.col("n").alias("reached"))


def bounded_reach(edges: DataFrame, depth: int = 3, limit: int = 160) -> DataFrame:
    """(node, reached, truncated): as ``blast_radius``, but no node looks at more than ``limit`` others.

    A node keeps the first of those that get to it, by steps and then by id, and
    stops once it has one more than the limit.  Of a hub's neighbours the first
    2 limit + 3 are enough: no more than limit + 2 of them are known or the node
    itself.  So rows grow with the nodes, not with the pairs.
    """
    most = limit + 1
    e = edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("source")).distinct()
    near = settled(e.withColumn("k", F.row_number().over(by("node", "source"))).where(F.col("k") <= 2 * most + 1))
    seen = edge = near.where(F.col("k") <= most).select("node", "source")
    for _ in range(depth - 1):
        have = seen.groupBy("node").agg(F.count("*").alias("have")).where(F.col("have") < most)
        far = edge.join(have.select("node"), "node").join(near.select(F.col("node").alias("source"), F.col("source").alias("far")), "source")
        new = far.where("far <> node").select("node", F.col("far").alias("source")).distinct().join(seen, ["node", "source"], "left_anti").join(have, "node")
        edge = settled(new.withColumn("k", F.row_number().over(by("node", "source"))).where(F.col("have") + F.col("k") <= most).select("node", "source"))
        if edge.isEmpty():
            break
        seen = settled(seen.unionByName(edge))
    return seen.groupBy("node").agg(F.least(F.count("*"), F.lit(limit)).alias("reached"), (F.count("*") > limit).alias("truncated"))


def reach_estimates(edges: DataFrame, depth: int = 3, lg_k: int = 11) -> DataFrame:
    """(node, reached): about how many others get to ``node`` in 1 to ``depth`` steps, from sketches that are joined along the edges.

    A node's sketch takes 2 ** ``lg_k`` bytes at most, whatever it stands for, and errs by some 1.04 / 2 ** (lg_k / 2).
    The first step sketches plain nodes.  After it a sketch moves only along edges
    whose source has grown in the step before, and a node that grows no more is
    left where it was written.  Edges are kept as lists of where a node leads
    (``idlists``), so ids are whole numbers; what would move more than the bytes
    of a round goes in rounds.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    to = _links(e, parts).groupBy("node").agg(F.collect_list("to").alias("to"), F.sum("m").alias("m"))
    first = e.repartition(parts, "dst").select("dst", F.explode(F.array("src", "dst")).alias("near")).groupBy("dst").agg(F.hll_sketch_agg("near", F.lit(lg_k)).alias("s"))
    grown = settled(first.select(F.col("dst").alias("node"), "s").join(to, "node", "left"))
    about, kept = (F.hll_sketch_estimate("s") - 1).alias("reached"), None
    for step in range(depth - 1):
        state = grown.select(F.explode("to").alias("to"), F.lit(0).alias("part"), F.col("s").alias("items"))
        rounds, new = idlists.rounds(grown.select("m", F.col("s").alias("items")), idlists.UNITED), None
        go_on = ["to", "m"] if step < depth - 2 else []
        for k in range(rounds):
            more = idlists.sent(state, "to", "node", "part", rounds, k).groupBy("node").agg(F.hll_union_agg("items").alias("more"))
            here = grown.where(F.pmod("node", F.lit(rounds)) == k).join(more, "node")  # who grows in a step has grown in the one before
            part = settled(here.select("node", F.hll_union("s", "more").alias("s"), *go_on))
            new = part if new is None else new.unionByName(part)
        still = grown.select("node", about).join(new.select("node"), "node", "left_anti")
        kept = still if kept is None else kept.unionByName(still)
        grown = new
    last = grown.select("node", about)
    return (last if kept is None else kept.unionByName(last)).where("reached > 0")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node that undirected edges reach.

    A round hangs every node on its least neighbour, if that is smaller, follows
    these to their roots and goes on with the edges between different roots: the
    edges get fewer from round to round, and none is looked at once its ends agree.
    """
    pair = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    e = settled(edges.where("src <> dst").select(*pair).distinct())
    found = None
    for _ in range(rounds):
        ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("near")), F.struct(F.col("dst").alias("node"), F.col("src").alias("near")))).alias("x")).select("x.*")
        label = settled(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")))
        moved = True
        while moved:  # a chain's length halves
            jump = label.join(label.select(F.col("node").alias("component"), F.col("component").alias("root")), "component")
            label = settled(jump.select("node", F.col("root").alias("component"), (F.col("root") < F.col("component")).alias("moved")))
            moved = not label.where("moved").isEmpty()
        label = label.select("node", "component")
        found = label if found is None else settled(found.join(label.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        e = e.join(label.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
        e = settled(e.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if e.isEmpty():
            return found
    raise RuntimeError(f"components did not settle in {rounds} rounds")
