"""Flow search and bounded reach against plain Python on small graphs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import flows as W
from quillspark.operators import graph

NODE = "id long, label string, qualified string, path string, signature string, kind string, role string, pagerank double"
EDGE = "id long, src long, dst long, type string, confidence string"


@pytest.mark.parametrize("seed", range(3))
def test_bounded_reach(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(12 + 30 * seed)) for _ in range(150)]
    into = {}
    for a, b in edges:
        if a != b:
            into.setdefault(b, set()).add(a)
    want = {}
    for v in into:
        seen, at = set(), {v}
        for _ in range(3):
            at = {s for x in at for s in into.get(x, ())} - seen - {v}
            seen |= at
        want[v] = len(seen)
    df = spark.createDataFrame(edges, "src long, dst long")
    for limit in (1, 5, 100):
        got = {x.node: (x.reached, x.truncated) for x in graph.bounded_reach(df, 3, limit).collect()}
        assert got == {v: (min(n, limit), n > limit) for v, n in want.items()}
    near = {x.node: x.reached for x in graph.reach_estimates(df, 3).collect()}
    assert near.keys() == want.keys() and all(abs(near[v] - n) <= 0.1 * n + 1 for v, n in want.items())


def world(seed):
    r = random.Random(seed)
    words = ["load", "save", "order_total", "price", "user", "cart", "token"]
    nodes = [(i, "_".join(r.sample(words, r.randint(1, 2))), f"mod{i % 5}.{r.choice(words)}{i}", r.choice(["src/a.py", "tests/b.py", "src/price.py"]), None if i % 3 else r.choice(words), r.choice(["route", "function", "method", "class", "file", None]), r.choice(["source", "test", None]), r.random() / 500) for i in range(30)]
    kinds = ["calls", "defines_route", "imports", "tested_by", "contains", "reads_data", "writes_data", "odd", "handles_failure"]
    edges = [(100 + k, r.randrange(30), r.randrange(30), r.choice(kinds), r.choice(["extracted", "user_confirmed", "guess"])) for k in range(90)]
    asked = [(1, "How does order_total load the user cart?"), (2, "What is the impact of price on save?"), (3, "lineage: token, read user"), (4, "the test of price"), (5, "how"), (6, "failure of mod1.load6 save cart order_total")]
    found = [(q, r.randrange(30), k) for q, _ in asked for k in range(3)]
    found = list({(q, n): (q, n, k) for q, n, k in found}.values())
    return nodes, edges, asked, found


def low(x):
    return (x or "").lower()


class Plain:
    """The same search, one question at a time."""

    def __init__(self, nodes, edges):
        self.nodes = {n[0]: dict(zip(("id", "label", "qualified", "path", "signature", "kind", "role", "pagerank"), n)) for n in nodes}
        self.edges = [dict(zip(("id", "src", "dst", "type", "confidence"), e)) for e in edges]

    def bonus(self, n):
        out = W.KINDS.get(n["kind"], 0.0)
        if (n["role"] or "source") in W.APART_ROLES or re.search(W.APART_PATH, low(n["path"])):
            out -= 40
        return out + min((n["pagerank"] or 0) * 10_000, 12.0)

    def has(self, n, t):
        return any(t in low(n[f]) for f in ("label", "qualified", "path", "signature"))

    def candidates(self, query, found):
        terms = list(dict.fromkeys(w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_-]{2,}", query) if w.lower() not in W.STOP))[:8]
        scores, anchors = {}, {}
        for n in self.nodes.values():
            if low(n["label"]) in terms:
                anchors[n["id"]] = terms.index(low(n["label"]))
                scores[n["id"]] = 240.0 - 18 * anchors[n["id"]]
        signals = sorted(terms, key=lambda t: (-int("_" in t or "-" in t), -len(t), terms.index(t)))[:2]
        hit = [n for n in self.nodes.values() if any(t in low(n[f]) for t in signals for f in ("label", "qualified", "path"))]
        hit.sort(key=lambda n: (low(n["label"]) not in signals, len(n["label"]), n["qualified"], n["id"]))
        for rank, n in enumerate(hit[:48]):
            best = max(
                50.0 - 2 * terms.index(t) - rank + (60 if low(n["label"]) == t else 30 if low(n["label"]).startswith(t) else 18 if t in low(n["label"]) else 0) + 12 * (t in low(n["qualified"])) + 6 * (t in low(n["path"]))
                for t in signals
            )
            scores[n["id"]] = max(scores.get(n["id"], -1e9), best)
        for n, rank in found:
            scores[n] = scores.get(n, 0.0) + max(38.0 - rank, 12.0)
        asked = " ".join(query.split()).lower()
        for i in scores:
            n = self.nodes[i]
            phrase = 240.0 if len(n["label"]) >= 4 and low(n["label"]) in asked else 80.0 if len(n["qualified"]) >= 6 and low(n["qualified"]) in asked else max(0, sum(self.has(n, t) for t in terms) - 1) * 80.0
            scores[i] = round(scores[i] + self.bonus(n) + phrase, 6)
            if i not in anchors and (at := [k for k, t in enumerate(terms) if self.has(n, t)]):
                anchors[i] = at[0]
        return terms, scores, anchors, sorted(scores, key=lambda i: (-scores[i], self.nodes[i]["qualified"], i))

    def ways(self, node, lens):
        sure = [e for e in self.edges if e["confidence"] in W.CERTAIN]
        types = {*W.RUNS, *W.SUPPORTS, "contains", *W.MORE.get(lens, ())}
        back = {*W.ENTERS, *W.BACKWARDS.get(lens, ())}
        kind = lambda i: self.nodes[i]["kind"]
        for e in sure:
            if e["src"] == node and e["type"] in types and (e["type"] != "contains" or kind(node) not in ("file", "project", None) and kind(e["dst"]) in ("function", "method", "component", "class", "route")):
                yield e, e["dst"], False
            if e["dst"] == node and e["type"] in back:
                yield e, e["src"], True

    def flows(self, query, found):
        terms, scores, anchors, order = self.candidates(query, found)
        lens = next((name for name, p in W.LENSES if re.search(p.removeprefix("(?i)"), query, re.I)), "execution")
        seeds = sorted(order[:10], key=lambda i: (anchors.get(i, 999), -scores[i], self.nodes[i]["qualified"], i))
        labels, later, first = set(), [], []
        for i in seeds:
            (later if low(self.nodes[i]["label"]) in labels else first).append(i)
            labels.add(low(self.nodes[i]["label"]))
        rank = lambda p: round(p["score"] + 70 * len(p["anchors"]) + 18 * len(p["said"]) - 3 * max(0, len(p["path"]) - 5), 6)
        key = lambda p: (-rank(p), p["path"], p["walked"])
        out = []
        for i in (first + later)[:6]:
            entry = sorted((e for e in self.edges if e["type"] == "defines_route" and e["confidence"] in W.CERTAIN), key=lambda e: e["id"])
            into, outof = [e for e in entry if e["dst"] == i], [e for e in entry if e["src"] == i]
            if self.nodes[i]["kind"] == "route" and into:
                path, walked = [i, into[0]["src"]], [into[0]["id"]]
            elif outof:
                path, walked = [outof[0]["dst"], i], [outof[0]["id"]]
            else:
                path, walked = [i], []
            said = {t for t in terms if any(self.has(self.nodes[n], t) for n in path)}
            beam = [{"path": path, "walked": walked, "score": scores[i] + 8 * len(said) + max(0, len(terms) - anchors.get(i, len(terms))) * 140.0, "said": said, "anchors": {n for n in path if n in anchors}}]
            done = []
            while beam:
                grown = []
                for p in beam:
                    if len(p["path"]) >= W.STEPS:
                        done.append(p)
                        continue
                    choices = []
                    for e, n, backwards in self.ways(p["path"][-1], lens):
                        if n in p["path"]:
                            continue
                        fresh = {t for t in terms if t not in p["said"] and self.has(self.nodes[n], t)}
                        meets = n in anchors and n not in p["anchors"]
                        gain = W.ADDS.get(e["type"], 4.0) + 16.0 * (e["type"] in W.PREFERS.get(lens, (*W.RUNS, "defines_route"))) - 2.0 * (backwards and lens not in ("impact", "health", "tests")) + 5.0 * (e["confidence"] == "user_confirmed")
                        new = {"path": [*p["path"], n], "walked": [*p["walked"], e["id"]], "score": p["score"] + gain + self.bonus(self.nodes[n]) + 26.0 * len(fresh) + (90.0 + 0.75 * scores[n] if meets else 0), "said": p["said"] | fresh, "anchors": p["anchors"] | ({n} if meets else set())}
                        (done if meets and len(new["said"]) >= 2 else choices).append(new)
                    grown += choices
                    if not choices:
                        done.append(p)
                beam = sorted(grown, key=key)[:6]
            out += sorted((p for p in done if p["walked"]), key=key)[:2]
        best = {}
        for p in out:
            k = tuple(p["path"])
            if k not in best or (-p["score"], p["walked"]) < (-best[k]["score"], best[k]["walked"]):
                best[k] = p
        return lens, [(p["path"], rank(p)) for p in sorted(best.values(), key=lambda p: (-rank(p), p["path"]))[:4]]


@pytest.mark.parametrize("seed", [1, 2])
def test_flows_equal_plain_python(spark, seed):
    nodes, edges, asked, found = world(seed)
    plain = Plain(nodes, edges)
    n, e, q = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), spark.createDataFrame(asked, "question_id int, query string")
    c = graph.settled(W.candidates(q, n, spark.createDataFrame(found, "question_id int, id long, rank int")))
    rows, got = c.collect(), {}
    for x in W.flows(q, n, e, c).orderBy("question_id", "place").collect():
        got.setdefault(x.question_id, []).append((x.lens, x.path, x.score))
    some = 0
    for i, query in asked:
        mine = [(a, b) for x, a, b in found if x == i]
        _, scores, anchors, order = plain.candidates(query, mine)
        assert [(x.id, x.score, x.anchor) for x in sorted((x for x in rows if x.question_id == i), key=lambda x: x.place)] == [(k, scores[k], anchors.get(k)) for k in order], query
        lens, want = plain.flows(query, mine)
        assert [(lens, p, pytest.approx(s)) for p, s in want] == got.get(i, []), query
        some += len(want)
    assert some > 6


def test_flows_without_nodes(spark):
    n, e, q = spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE), spark.createDataFrame([(1, "load save")], "question_id int, query string")
    c = W.candidates(q, n, spark.createDataFrame([], "question_id int, id long, rank int"))
    assert c.count() == 0 and W.flows(q, n, e, c).count() == 0


def test_ways_are_made_for_the_ends_of_beams_only(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(W, "settled", lambda df, keep=W.settled: stored.append(keep(df)) or stored[-1])
    nodes = spark.createDataFrame([(k, f"part_{k}", f"mod.part_{k}", "src/a.py", None, "function", "source", 0.0) for k in range(400)], NODE)
    edges = spark.createDataFrame([(1000 + k, k, k + 1, "calls", "extracted") for k in range(399)], EDGE)
    asked = spark.createDataFrame([(1, "How does part_7 run?")], "question_id long, query string")
    found = W.candidates(asked, nodes, spark.createDataFrame([], "question_id long, id long, rank int"))
    got = W.flows(asked, nodes, edges, found).collect()
    assert got and max(df.count() for df in stored) < 100  # 399 edges under eleven lenses before
