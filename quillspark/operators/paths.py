"""Strongly connected parts, greedy flows and ranked paths of directed edge tables, and edges chosen under a bound of degree."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from . import graph

#: Terms up to which those of too many items are broadcast, about 60 bytes each.
BROADCAST_TERMS = 1_000_000
#: Pairs on lists of items that a task counts, and the most tasks.
PAIRS, MOST_TASKS = 2_000_000, 20_000
#: Terms of an item of which three stand for what it shares with others, and items that are met first.
FIRST, HUBS = 6, 256


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its strongly connected part, for every node of ``edges`` (src, dst).

    Per round two least nodes spread at once along the edges: the least that a
    node reaches, and the least that reaches it.  Where they are one, the node
    is in that node's part.  Parts agree in both, so only edges whose ends agree
    stay for the next round.  All steps are grouped minima.
    """
    e = settled(edges.where("src <> dst").select("src", "dst").distinct())
    nodes = settled(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    done = None
    while not e.isEmpty():
        state = settled(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().select("node", F.col("node").alias("to"), F.col("node").alias("fro")))
        while True:
            ahead = e.join(state.select(F.col("node").alias("dst"), "to"), "dst").select(F.col("src").alias("node"), F.col("to"), F.lit(None).cast("long").alias("fro"))
            behind = e.join(state.select(F.col("node").alias("src"), "fro"), "src").select(F.col("dst").alias("node"), F.lit(None).cast("long").alias("to"), "fro")
            new = settled(state.unionByName(ahead).unionByName(behind).groupBy("node").agg(F.min("to").alias("to"), F.min("fro").alias("fro")))
            moved = new.agg(F.sum(F.col("to") + F.col("fro")).cast("decimal(38,0)")).first()[0]
            was = state.agg(F.sum(F.col("to") + F.col("fro")).cast("decimal(38,0)")).first()[0]
            state = new
            if moved == was:  # minima only fall, so an equal sum is an equal state
                break
        found = state.where("to = fro").select("node", F.col("to").alias("component"))
        done = found if done is None else settled(done.unionByName(found))
        left = state.where("to <> fro")
        a, b = (left.select(F.col("node").alias(n), F.col("to").alias(f"to_{n}"), F.col("fro").alias(f"fro_{n}")) for n in ("src", "dst"))
        e = settled(e.join(a, "src").join(b, "dst").where("to_src = to_dst and fro_src = fro_dst").select("src", "dst"))
    if done is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(done, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def ranked_paths(starts: DataFrame, edges: DataFrame, steps: int, beam: int, order: list[Column], grow: Column | None = None) -> DataFrame:
    """(start, path, score): from each start up to ``beam`` paths, step by step; a path that can't go on stays as it is.

    ``starts``: start, score; ``edges``: src, dst and what ``order`` and ``grow``
    read.  Of a start's grown paths those first in ``order`` are kept at every
    step; ``grow`` is what an edge adds to the score.  No path meets a node twice.
    """
    live = starts.select("start", F.array("start").alias("path"), F.col("score").cast("double").alias("score"))
    ended = None
    for _ in range(steps):
        grown = live.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        rank = F.row_number().over(Window.partitionBy("start").orderBy(*order, "path"))
        added = F.lit(0.0) if grow is None else grow
        new = grown.withColumn("__rank", rank).where(F.col("__rank") <= beam)
        new = settled(new.select("start", F.concat("path", F.array("dst")).alias("path"), (F.col("score") + added).alias("score")))
        stuck = live.join(grown.select("start", "path").distinct(), ["start", "path"], "left_anti")
        ended = stuck if ended is None else ended.unionByName(stuck)
        live = new
        if live.isEmpty():
            break
    return live if ended is None else ended.unionByName(live)


def bounded_edges(candidates: DataFrame, most: int = 3, limit: int = 240) -> DataFrame:
    """Of the candidates (a, b, score) those that a greedy choice by score takes while both ends have fewer than ``most`` edges; the best ``limit``.

    An edge is taken once fewer better ones are left at either end than the end
    may still take; taking all such edges together, round by round, gives what
    one pass over the sorted edges gives.
    """
    left = settled(candidates.select("a", "b", "score"))
    order = [F.desc("score"), "a", "b"]
    taken = left.limit(0)
    room = left.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("room", F.lit(most))
    while not left.isEmpty():
        ends = left.withColumn("node", F.explode(F.array("a", "b"))).join(room, "node")
        place = F.row_number().over(Window.partitionBy("node").orderBy(*order))
        now = settled(ends.withColumn("fits", place <= F.col("room")).groupBy("a", "b", "score").agg(F.bool_and("fits").alias("sure")).where("sure").drop("sure"))
        taken = settled(taken.unionByName(now))
        used = taken.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        room = settled(room.select("node").join(used, "node", "left").select("node", (F.lit(most) - F.coalesce("used", F.lit(0))).alias("room")))
        free = room.where("room > 0").select("node")
        left = left.join(now, ["a", "b"], "left_anti")
        left = settled(left.join(free.withColumnRenamed("node", "a"), "a", "left_semi").join(free.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b", "score"))
    return taken.orderBy(*order).limit(limit)


def shared_term_pairs(terms: DataFrame, most: int = 200, unique: bool = False) -> DataFrame:
    """(a, b, shared): how many terms two items share, from (item, term); a term that more than ``most`` items have is left out, so an item meets at most ``most`` others by each term.

    Terms are counted first, so that only the rows of rare ones move.  An item
    goes on with the list of those after it, term by term, and the number of
    tasks grows with the pairs on these lists, which are counted where they
    meet.  ``unique`` says that no row of ``terms`` comes twice.
    """
    t = terms.select("item", "term") if unique else terms.select("item", "term").distinct()
    often = settled(t.groupBy("term").agg(F.count("*").alias("n")).where("n > 1"))
    met, too_many = often.agg(F.sum(F.when(F.col("n") <= most, F.col("n") * (F.col("n") - 1) / 2)).cast("long"), F.count_if(F.col("n") > most)).first()
    gone = often.where(F.col("n") > most).select("term")
    rare = t.join(F.broadcast(gone) if too_many <= BROADCAST_TERMS else gone, "term", "left_anti")
    tasks = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-(met or 0) // PAIRS)))
    lists = rare.repartition(tasks, "term").groupBy("term").agg(F.sort_array(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    after = lists.select("items", F.posexplode("items").alias("k", "a")).where(F.size("items") > F.col("k") + 1).select("a", F.slice("items", F.col("k") + 2, most).alias("others"))
    pairs = after.repartition(tasks, "a").select("a", F.explode("others").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def related_groups(terms: DataFrame, unique: bool = False) -> DataFrame:
    """(item, group): items that share terms with others and the smallest item of their group, from (item, term), whatever number of items a term has.

    Two items are related that share three terms, or two that are two fifths of
    the smaller one's.  Items with three of their ``FIRST`` most frequent terms
    in common are related, and put together by stars without looking at pairs.
    What relates different groups then has an end outside the largest one: the
    items outside it meet the ``HUBS`` items of the most terms, which leaves few,
    and these meet all items that have one of their terms.  ``unique`` says that
    no row of ``terms`` comes twice.
    """
    t = terms.select("item", "term").where("item is not null and term is not null")
    t = t if unique else t.distinct()
    often = settled(t.groupBy("term").agg(F.count("*").alias("often")).where("often > 1").withColumn("k", F.monotonically_increasing_id()))
    has = F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("often", "k"))), asc=False)
    items = settled(t.join(often, "term", "left").groupBy("item").agg(F.count("*").alias("n"), has.alias("has")).where("size(has) > 1"))
    triples = F.array(*(F.when(F.size("has") > c, F.struct(*(F.get("has", F.lit(x))["k"] for x in (a, b, c)))) for a, b, c in combinations(range(FIRST), 3)))
    met = items.select("item", F.explode(triples).alias("x")).where("x is not null")
    stars = met.groupBy("x").agg(F.min("item").alias("least"), F.count("*").alias("many")).where("many > 1")
    found = graph.components(met.join(stars, "x").select(F.col("item").alias("src"), F.col("least").alias("dst")))
    of = settled(items.join(found.withColumnRenamed("node", "item"), "item", "left").select("item", "n", F.coalesce("component", "item").alias("group")))
    hubs = items.orderBy(F.desc("n"), "item").limit(HUBS)
    for others in (hubs, items):
        related = _between_groups(of, items, others)
        joined = graph.components(related.select(F.col("group_a").alias("src"), F.col("group_b").alias("dst")))
        of = settled(of.join(joined.withColumnRenamed("node", "group"), "group", "left").select("item", "n", F.coalesce("component", "group").alias("group")))
    return of.select("item", "group")


def _between_groups(of: DataFrame, items: DataFrame, others: DataFrame) -> DataFrame:
    """(group_a, group_b) of related items in different groups, one of them outside the largest group and one of ``others``.

    A term's items go to those outside as lists, and pairs are counted there, by
    tasks whose number grows with the pairs.
    """
    parts = int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = of.groupBy("group").count().orderBy(F.desc("count"), "group").limit(1).select("group")
    left = of.join(largest, "group", "left_anti").select("item")
    outside = settled(items.join(left, "item", "left_semi").select(F.col("item").alias("a"), F.explode("has.k").alias("k")))
    rows = others.select(F.col("item").alias("b"), F.explode("has.k").alias("k")).join(outside.select("k").distinct(), "k", "left_semi")
    often = settled(rows.groupBy("k").agg(F.count("*").alias("often")))
    walks = often.join(outside, "k").agg(F.sum("often")).first()[0] or 0
    tasks = max(parts, min(MOST_TASKS, -(-walks // PAIRS)))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("often") / graph.LINKS))
    lists = rows.join(often, "k").groupBy("k", part.alias("part")).agg(F.collect_list("b").alias("others"))
    pairs = outside.join(lists, "k").select("a", "others").repartition(tasks, "a").select("a", F.explode("others").alias("b")).where("a <> b")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("both")).where("both > 1")
    a, b = (of.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}"), F.col("group").alias(f"group_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where("group_a <> group_b and (both >= 3 or both * 5 >= least(n_a, n_b) * 2)").select("group_a", "group_b")
