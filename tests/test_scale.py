"""Work that has to be spread, done once, or kept within bounds as tables grow."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import planner
from quillspark.operators import atoms as A
from quillspark.operators import graph, idlists, lexical, paths, vector
from quillspark.plans.registry import QUERIES

HALVES = (1.6391499999999999, 1.6392499999999999, 1.6393499999999999, 1.6394499999999999, 1.6395499999999998)
TURN = "session_id string, date string, turn int, role string, text string"


def test_turns_of_one_split_are_compiled_by_all_tasks(spark):
    turns = spark.createDataFrame([(f"{k % 7}-a", "2024-01-02", k, "user", f"I now own {k} lamps.\n\nI like tea.") for k in range(50)], TURN).coalesce(1)
    facts, _ = A.compiled(turns)
    assert facts.rdd.getNumPartitions() >= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # arrays of units, facts and claims are not worked out once more to ask whether they are empty
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "(size(" not in "".join(line for line in plan.splitlines() if "Filter" in line)


def test_counters_compile_once(spark):
    turns = spark.createDataFrame([("1-a", "2024-01-02", 0, "user", "I now have 3 bikes."), ("1-a", "2024-01-03", 1, "user", "I just bought a new bike.")], TURN)
    facts, _ = A.compiled(turns)
    got = A.counters(facts.withColumn("owner", F.lit(1)), "owner")
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    assert [(r.category, r.held, r.added, r.current) for r in got.collect()] == [("bike", 3.0, 1.0, 4.0)]


def test_codes_that_hide_the_best_do_not_lose_them(spark):
    # 200 rows whose codes equal those of the five best, and whose ids come first
    rows = [(0, [1.0, 0.0])] + [(k, [0.5001, 1.0]) for k in range(1, 201)] + [(k, [0.5037, 1.0]) for k in range(201, 206)]
    v = spark.createDataFrame(rows, "id long, v array<float>")
    got = vector.quantized_top_k(v.where("id = 0"), v, 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(k, 0.5037) for k in range(201, 206)]


def test_scores_are_rounded_once(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [0.466549999]), (2, [0.4665]), (3, [0.00001])], "id long, v array<double>")
    got = vector.top_k(v.where("id = 0"), v, 5).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 0.4665), (2, 0.4665)]


def test_a_task_of_the_search_gives_the_best_of_all_its_blocks(spark, monkeypatch):
    # scores rise from block to block, so that each has better rows than those before
    v = spark.createDataFrame([(k, [1.0 + k]) for k in range(300)], "id long, v array<float>").coalesce(1)
    made = []
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, *a, f=type(v).mapInArrow, **b: made.append(f(self, *a, **b)) or made[-1])

    def searched():
        got = vector.top_k(v.where("id % 20 = 0"), v, 5, block=16).collect()
        assert made[-1].rdd.getNumPartitions() == 1
        return sorted((r.query_id, r.rank, r.id, r.score) for r in got), made[-1].count()

    want = [(q, r, 300 - r, (1.0 + q) * (301 - r)) for q in range(0, 300, 20) for r in range(1, 6)]
    assert searched() == (want, 75)  # 1,425 before, from nineteen blocks
    monkeypatch.setattr(vector, "HELD", 20)  # what goes beyond leaves the task early
    got, left = searched()
    assert got == want and left > 75


def test_sums_of_scores_are_dealt_over_more_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"lamp {'tea ' * (k % 3)} word{k % 7}") for k in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"tea lamp word{k}") for k in range(5)], "item_id long, text string")
    want = sorted(map(tuple, lexical.bm25(docs, items).collect()))
    monkeypatch.setattr(lexical, "PAIRS", 5)
    assert lexical.bm25_scores(docs, items).rdd.getNumPartitions() >= 30
    assert sorted(map(tuple, lexical.bm25(docs, items).collect())) == want


def test_pairs_of_the_last_step_are_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(graph, "settled", lambda df, keep=graph.settled: stored.append(df) or keep(df))
    e = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(k, 20) for k in range(9)] + [(20, 0)], "src long, dst long")
    got = {r.node: r.reached for r in graph.blast_radius(e, 2).collect()}
    assert got[20] == 9 and got[0] == 9 and got[1] == 2 and got[2] == 2 and len(stored) == 1


def test_sketches_move_only_where_nodes_have_grown(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(graph, "settled", lambda df, keep=graph.settled: stored.append(keep(df)) or stored[-1])
    e = spark.createDataFrame([(k, 100 + k) for k in range(50)] + [(100, 200), (200, 300)], "src long, dst long")
    got = {r.node: r.reached for r in graph.reach_estimates(e, 3).collect()}
    assert got == {**{100 + k: 1 for k in range(50)}, 200: 2, 300: 3}
    assert [df.count() for df in stored if "s" in df.columns] == [52, 2, 1]  # all 102 in each step before


def test_components_leave_edges_whose_ends_agree(spark):
    # a chain and a star, which spreading minima take many rounds to cross
    e = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(k, 999) for k in range(500, 520)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(e, 2).collect()}
    assert got == {**{k: 0 for k in range(201)}, **{k: 500 for k in range(500, 520)}, 999: 500}


def test_pagerank_cuts_the_links_of_a_node_into_lists(spark, monkeypatch):
    e = spark.createDataFrame([(0, k) for k in range(1, 40)] + [(k, (k * 7) % 40) for k in range(1, 40)], "src long, dst long")
    want = {r.node: r.rank for r in graph.pagerank(e, 5).collect()}
    monkeypatch.setattr(graph, "LINKS", 4)
    stored = []
    monkeypatch.setattr(graph, "settled", lambda df, keep=graph.settled: stored.append(keep(df)) or stored[-1])
    got = {r.node: r.rank for r in graph.pagerank(e, 5).collect()}
    assert got == pytest.approx(want, abs=1e-11) and len(got) == 40
    lists = [df for df in stored if "to" in df.columns][0].selectExpr("size(to) as n").collect()
    assert 1 < sum(r.n == 1 for r in lists) and max(r.n for r in lists) < 39


def test_quantized_scores_are_rounded_as_in_doubles(spark):
    # products with 10,000 are exactly halves in doubles, though the numbers' decimals lie below
    rows = [(0, [1.0])] + [(k, [x]) for k, x in enumerate(HALVES, 1)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    want = {k: math.floor(x * 10.0**4 + 0.5) / 10.0**4 for k, x in enumerate(HALVES, 1)}
    assert {r.id: r.score for r in vector.quantized_top_k(v.where("id = 0"), v, 5).collect()} == want
    assert {r.id: r.score for r in vector.top_k(v.where("id = 0"), v, 5).collect()} == want


def test_pairs_of_parts_are_dealt_over_more_tasks(spark, sf_dir, monkeypatch):
    from quillspark.plans import project

    query = QUERIES["r17_change_context"]
    want = sorted(map(tuple, query(spark, sf_dir).collect()))
    monkeypatch.setattr(project, "PAIRS", 300, raising=False)
    got = query(spark, sf_dir)
    assert got.rdd.getNumPartitions() > 50
    assert sorted(map(tuple, got.collect())) == want


def test_pairs_of_terms_are_dealt_over_more_tasks(spark, monkeypatch):
    rows = [(i, f"t{t}") for t in range(12) for i in range(t, t + 9)] + [(i, "all") for i in range(40)] + [(3, "t0"), (None, "t0")]
    terms = spark.createDataFrame(rows, "item long, term string")
    want = {}
    for t in range(1, 12):  # t0 has ten rows with the null, as SQL counts
        for a in range(t, t + 9):
            for b in range(a + 1, t + 9):
                want[a, b] = want.get((a, b), 0) + 1
    for a in range(9):
        for b in range(a + 1, 9):
            want[a, b] = want.get((a, b), 0) + 1
    monkeypatch.setattr(paths, "PAIRS", 20, raising=False)
    monkeypatch.setattr(paths, "BROADCAST_TERMS", 0, raising=False)
    got = paths.shared_term_pairs(terms, 10)
    assert got.rdd.getNumPartitions() >= 20
    assert {(r.a, r.b): r.shared for r in got.collect()} == want


def test_pairs_move_as_lists(spark):
    terms = spark.createDataFrame([(i, "x") for i in range(9)], "item long, term string")
    got = paths.shared_term_pairs(terms, 10, unique=True)
    assert got.count() == 36
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "others" in plan


def test_pairs_that_share_one_term_are_not_stored(spark, sf_dir, monkeypatch):
    from quillspark.plans import paths as plans

    stored = []
    keep = graph.settled
    for module in (graph, paths):
        monkeypatch.setattr(module, "settled", lambda df: stored.append(keep(df)) or stored[-1])
    assert QUERIES["c02_lexical_groups"](spark, sf_dir).count() > 0
    assert not any("shared" in df.columns for df in stored)
    d = spark.createDataFrame([(1, "lamp lamp tree"), (1, "lamp tree"), (2, None), (3, "tree")], "doc_id long, text string")
    monkeypatch.setattr(plans, "load", lambda *a: d)
    assert sorted(map(tuple, plans._terms(spark, "").collect())) == [(1, "lamp"), (1, "tree"), (3, "tree")]


def test_questions_are_dealt_out_and_their_terms_read_once(spark, sf_dir):
    plan = QUERIES["f17_atomic_plans"](spark, sf_dir)._jdf.queryExecution()
    assert "RepartitionByExpression [c_custkey" in plan.optimizedPlan().toString()
    one = spark.createDataFrame([("Did my doctor call?",)], "q string").select(planner.plan(F.col("q")).alias("p"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("[a-z0-9]+") <= 2  # of the question, and of what it counts
    assert one.first().p.aliases == ["clinician", "physician"]


def test_claims_are_packed_once_and_scored_within_their_question(spark, sf_dir, monkeypatch):
    from quillspark.plans import consolidated

    stored = []
    monkeypatch.setattr(consolidated, "settled", lambda df, keep=consolidated.settled: stored.append(keep(df)) or stored[-1])
    assert QUERIES["m14_evidence_packets"](spark, sf_dir).count() > 0
    packed = [df for df in stored if "taken" in df.columns and "line" not in df.columns]
    assert len(packed) == 1 and packed[0].where("not taken").isEmpty()
    turns = spark.createDataFrame([(1, "a", "2024-01-02", 0, 0, "user", "I love tea. I like desks.")], "question_id long, session string, date string, rank int, turn int, speaker string, text string")
    asked = spark.createDataFrame([(1, "Which tea and desks?", "multi-session")], "question_id long, question string, kind string")
    plan = consolidated.O.ledger(consolidated.O.claim_rows(turns), asked)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "sentence" in line]


def test_facts_of_packs_move_without_their_texts_and_are_not_stored(spark, sf_dir):
    for name in ("m11_compiled_pack", "m10_atomic_contracts"):
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "ExistingRDD" not in plan
        moved = [block for block in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", block.strip())]
        assert moved and not [block for block in moved if re.search(r"\b(excerpt|object|qualifiers|words|terms)#", block)]


def reached(edges, depth):
    into = {}
    for a, b in edges:
        if a != b:
            into.setdefault(b, set()).add(a)
    out = {}
    for v in into:
        seen, at = set(), {v}
        for _ in range(depth):
            at = {x for y in at for x in into.get(y, ())} - seen - {v}
            seen |= at
        out[v] = len(seen)
    return out


def test_pairs_of_the_last_step_move_as_lists(spark, monkeypatch):
    moved = []
    monkeypatch.setattr(idlists, "counted", lambda df, *a, f=idlists.counted: moved.append(df) or f(df, *a))
    edges = [(k, 1000) for k in range(200)] + [(1000, 2000 + k) for k in range(50)]
    got = {r.node: r.reached for r in graph.blast_radius(spark.createDataFrame(edges, "src long, dst long"), 3).collect()}
    assert got == reached(edges, 3) and got[2007] == 201
    assert moved[0].count() < 400  # rows; the pairs are 10,250


@pytest.mark.parametrize("held, most, size", [(10**6, 1024, 1 << 20), (7, 2, 9)])
def test_lists_are_cut_and_counted_in_parts(spark, monkeypatch, held, most, size):
    for where, name, value in ((graph, "HELD", held), (graph, "WALKS", 50), (idlists, "LIST", most), (idlists, "BYTES", size), (idlists, "PENDING", 3)):
        monkeypatch.setattr(where, name, value)
    r = random.Random(5)
    nodes = [*range(25), -1, -(2**62), 2**62, 2**40]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(90)] + [(3, None), (None, 4)]
    df = spark.createDataFrame(edges, "src long, dst long")
    for depth in (1, 2, 3, 4):
        want = reached([e for e in edges if None not in e], depth)
        assert {x.node: x.reached for x in graph.blast_radius(df, depth).collect()} == want
    assert graph.blast_radius(df.limit(0)).count() == 0


def test_what_was_shuffled_for_a_checkpoint_is_removed(spark):
    from quillspark.session import settled

    kept = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    was = set(re.findall(r"\d+", kept.keys().toString()))
    rows = settled(df)
    assert set(re.findall(r"\d+", kept.keys().toString())) <= was
    assert rows.count() == df.count() == len(settled(df).collect()) == len(df.collect()) == 7


def test_lists_and_sketches_move_in_rounds(spark, monkeypatch):
    r = random.Random(9)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(120)] + [(k, 50) for k in range(40)] + [(50, 60 + k) for k in range(9)] + [(7, None)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = reached([e for e in edges if None not in e], 3)
    near = {x.node: x.reached for x in graph.reach_estimates(df, 3).collect()}
    stored = []
    monkeypatch.setattr(graph, "settled", lambda df, keep=graph.settled: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(idlists, "MOVED", 1500)
    monkeypatch.setattr(idlists, "UNITED", 1500)
    assert {x.node: x.reached for x in graph.blast_radius(df, 3).collect()} == want
    assert len([x for x in stored if x.columns == ["node", "part", "n"]]) > 2
    stored.clear()
    assert {x.node: x.reached for x in graph.reach_estimates(df, 3).collect()} == near
    assert near.keys() == want.keys() and all(abs(near[v] - n) <= 0.05 * n for v, n in want.items())
    assert len([x for x in stored if "s" in x.columns]) > 4
    assert not [x for x in stored if {"src", "dst"} & set(x.columns)]  # edges are kept as lists


def test_terms_of_many_documents_group_them(spark, monkeypatch):
    from quillspark.plans import paths as plans

    rows = [(k, f"lamp tree river own{k}") for k in range(300)] + [(400 + k, f"lamp tree river stone{k} cloud{k} field{k} house{k}") for k in range(3)] + [(500, "lamp apple"), (501, "lamp apple"), (502, "lamp"), (503, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(plans, "load", lambda *a: d)
    got = {r.doc_id: (r.grp, r.size) for r in plans.c02_lexical_groups(spark, "").collect()}
    assert got == {**dict.fromkeys([*range(300), 400, 401, 402], (0, 303)), 500: (500, 2), 501: (500, 2)}


@pytest.mark.parametrize("first, hubs, bound", [(6, 256, 10**6), (3, 2, 4), (0, 0, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, first, hubs, bound):
    for where, name, value in ((paths, "FIRST", first), (paths, "HUBS", hubs), (paths, "PAIRS", bound), (graph, "LINKS", bound)):
        monkeypatch.setattr(where, name, value)
    r = random.Random(hubs)
    has = {k: {f"t{r.randrange(9) if r.random() < 0.1 else 10 + 7 * (k % 6) + r.randrange(7)}" for _ in range(r.randrange(1, 8))} for k in range(60)}
    related = [(a, b) for a in has for b in has if a < b and ((n := len(has[a] & has[b])) >= 3 or n == 2 and n * 5 >= 2 * min(len(has[a]), len(has[b])))]
    want = {k: k for k in has}
    for _ in has:
        for a, b in related:
            want[a] = want[b] = min(want[a], want[b])
    assert 5 < len(set(want.values())) < 50
    terms = spark.createDataFrame([(k, t) for k, ts in has.items() for t in ts] + [(None, "t1"), (None, "t2"), (None, "t3"), (1, None), (1, min(has[1]))], "item long, term string")
    got = {x.item: x.group for x in paths.related_groups(terms).collect()}
    assert {k: g for k, g in want.items() if list(want.values()).count(g) > 1}.items() <= got.items()
    assert all(want[k] == g for k, g in got.items())
