"""Flows through a code graph that answer questions: where they may begin, and ranked paths under the question's lens.

``nodes``: id, label, qualified, path, signature, kind, role, pagerank;
``edges``: id, src, dst, type, confidence; ``questions``: question_id, query.
All questions are answered together.  They are a stated set, which meets the
nodes once, to find candidates; from then on only the beams move: a question
has at most ``SEEDS`` seeds with ``BEAM`` paths each, a path is grown by at most
``FAN`` edges each way, for at most ``STEPS`` nodes.  That bounds what a question
may look at whatever the graph's size, so there is no running budget, which
would depend on the order in which one thread meets the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statements import squeezed
from ..session import settled

#: Nodes of a path, beams, seeds, paths of a seed and of a question, edges of a node each way, terms of a question, candidates and those found by words.
STEPS, BEAM, SEEDS, OF_SEED, PATHS, FAN, TERMS, CANDIDATES, WORDED = 8, 6, 6, 2, 4, 96, 8, 160, 48
#: Words that are no terms.
STOP = (
    "a an and architecture code codebase diagram does explain flow for from how in is it map me of project show system the this through to trace visualize what where with work works into throughout executes "
    "produces reaches data stored component function method file api request requests change changes affect affected coverage test tests can while processed process fail failure error exception fallback retry recover recovery"
).split()
#: Lenses by what a question says (first match wins).
LENSES = (
    ("impact", r"(?i)\b(impact|blast radius|depends on|affect|affected|changes?|downstream)\b"),
    ("lineage", r"(?i)\b(data lineage|lineage|stored|database|persist|read|write|transform)\b"),
    ("security", r"(?i)\b(security|untrusted|validate|authorize|authentication|permission|secret|sensitive)\b"),
    ("failure", r"(?i)\b(fail|failure|error|exception|fallback|retry|rollback|recover|cancel)\b"),
    ("async", r"(?i)\b(async|background|job|queue|event|ipc|worker|spawn)\b"),
    ("tests", r"(?i)\b(test|tests|coverage|covered)\b"),
    ("release", r"(?i)\b(release|version|snapshot|regression|since|previous)\b"),
    ("architecture", r"(?i)\b(architecture|drift|decision|module|router|registration)\b"),
    ("health", r"(?i)\b(dead code|unused|unreferenced|coupling|hotspot|cycle)\b"),
    ("documentation", r"(?i)\b(document|documentation|onboard|walkthrough)\b"),
)
#: Kinds of edges that run, that enter and that support; more of a lens, those it reads backwards, those it prefers; what each adds.
RUNS = ("calls", "dispatches", "http_request", "dispatches_job", "sends_ipc", "emits_event")
ENTERS = ("defines_route", "handles_ipc", "listens_event", "reads_data", "handles_failure")
SUPPORTS = ("uses_schema", "configured_by", "registers_router", "imports", "reads_data", "writes_data", "raises_failure", "tested_by")
MORE = {"failure": ("handles_failure",), "architecture": ("defines_route",)}
CALLERS = ("calls", "dispatches", "imports", "tested_by")
BACKWARDS = {"impact": CALLERS, "health": CALLERS, "tests": CALLERS, "lineage": ("writes_data", "uses_schema"), "async": ("dispatches_job", "sends_ipc", "emits_event")}
PREFERS = {
    "impact": CALLERS, "lineage": ("reads_data", "writes_data", "uses_schema"), "failure": ("raises_failure", "handles_failure"),
    "async": ("dispatches", "dispatches_job", "sends_ipc", "handles_ipc", "emits_event", "listens_event"), "tests": ("tested_by", "calls", "imports"), "architecture": ("imports", "registers_router", "defines_route"),
}
ADDS = {
    "calls": 18.0, "defines_route": 25.0, "http_request": 25.0, "dispatches": 22.0, "dispatches_job": 23.0, "sends_ipc": 23.0, "handles_ipc": 24.0, "emits_event": 20.0, "listens_event": 22.0, "reads_data": 18.0,
    "writes_data": 20.0, "raises_failure": 18.0, "handles_failure": 20.0, "registers_router": 14.0, "uses_schema": 12.0, "configured_by": 8.0, "imports": 5.0, "contains": 7.0, "tested_by": 12.0,
}
OTHER_EDGE, PREFERRED, AGAINST, CONFIRMED = 4.0, 16.0, 2.0, 5.0
#: What kinds of nodes add, what tests and the like take, at most from rank.
KINDS = {"route": 22.0, "function": 18.0, "method": 17.0, "class": 10.0, "file": 4.0}
APART, APART_ROLES, APART_PATH, RANK_TIMES, RANK_MOST = 40.0, ("test", "fixture", "generated", "vendor"), r"(^|/)(tests?|__tests__|fixtures?|generated|vendor)(/|$)", 10_000, 12.0
CERTAIN = ("extracted", "user_confirmed")


def lens(query: Column) -> Column:
    out = F
    for name, pattern in LENSES:
        out = out.when(query.rlike(pattern), name)
    return out.otherwise("execution")


def terms(query: Column) -> Column:
    found = F.transform(F.regexp_extract_all(query, F.lit(r"[A-Za-z_][A-Za-z0-9_-]{2,}"), 0), F.lower)
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(STOP))), 1, TERMS)


def _by_lens(table: dict, lens_: Column) -> Column:
    """The array that ``table`` has for the lens; empty for others."""
    out = F.array().cast("array<string>")
    for name, kinds in table.items():
        out = F.when(lens_ == name, F.array(*map(F.lit, kinds))).otherwise(out)
    return out


def edge_score(kind: Column, lens_: Column, backwards: Column) -> Column:
    base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ADDS.items() for x in kv)), kind), F.lit(OTHER_EDGE))
    liked = F.when(lens_.isin(*PREFERS), F.array_contains(_by_lens(PREFERS, lens_), kind)).otherwise(kind.isin(*RUNS, "defines_route"))
    return base + F.when(liked, PREFERRED).otherwise(0.0) - F.when(backwards & ~lens_.isin("impact", "health", "tests"), AGAINST).otherwise(0.0)


def bonus() -> Column:
    """What a node adds by kind, place and rank."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("kind")), F.lit(0.0))
    apart = F.coalesce("role", F.lit("source")).isin(*APART_ROLES) | F.lower(F.translate(F.coalesce("path", F.lit("")), "\\", "/")).rlike(APART_PATH)
    return kind - F.when(apart, APART).otherwise(0.0) + F.least(F.coalesce("pagerank", F.lit(0.0)) * RANK_TIMES, F.lit(RANK_MOST))


def _said(*columns: str) -> list[Column]:
    return [F.lower(F.coalesce(c, F.lit(""))) for c in columns]


def _hits(words: Column, fields: list[Column]) -> Column:
    """Which of ``words`` stand in one of the fields."""
    return F.filter(words, lambda w: F.greatest(*(F.contains(f, w) for f in fields)))


def candidates(questions: DataFrame, nodes: DataFrame, evidence: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(question_id, id, score, anchor, label, qualified, place): where flows may begin; ``anchor`` is the place of the first term that a candidate has.

    A label that is a term scores by the term's place; else the two most telling
    terms (with a joint, then the longest) are looked for in label, name and
    path, the first ``WORDED`` nodes counting.  ``evidence`` (question_id, id, rank
    from 0) adds what search found.
    """
    q = questions.select("question_id", F.lower(squeezed(F.col("query"))).alias("asked"), terms(F.col("query")).alias("terms"))
    order = F.transform("terms", lambda t, i: F.struct((~t.rlike("[_-]")).cast("int").alias("a"), (-F.length(t)).alias("b"), i.alias("i"), t.alias("t")))
    q = q.withColumn("signals", F.transform(F.slice(F.array_sort(order), 1, 2), lambda s: F.struct(s["t"].alias("t"), s["i"].alias("i"))))
    label, name, path, signature = _said("label", "qualified", "path", "signature")
    given = evidence.select("question_id", "id", F.col("rank").alias("found"))
    every = nodes.withColumn("extra", bonus()).join(q)  # a stated set of questions against all nodes
    at = F.array_position("terms", label) - 1
    telling = _hits(F.transform("signals", lambda s: s["t"]), [label, name, path])
    hits = every.withColumn("at", F.when(at >= 0, at)).withColumn("telling", telling).withColumn("all", _hits(F.col("terms"), [label, name, path, signature]))
    hits = hits.join(given, ["question_id", "id"], "left").where(F.col("at").isNotNull() | (F.size("telling") > 0) | F.col("found").isNotNull())
    hits = settled(hits)
    by = Window.partitionBy("question_id")
    hits = hits.withColumn("nth", F.row_number().over(by.orderBy(F.col("at").isNull(), "qualified", "id"))).withColumn("exact", F.col("at").isNotNull() & (F.col("nth") <= limit))
    full = F.max(F.when(F.col("exact"), F.col("nth"))).over(by) >= limit
    in_signals = F.exists("signals", lambda s: s["t"] == label)
    worded = F.row_number().over(by.orderBy(F.size("telling") == 0, ~in_signals, F.length(label), "qualified", "id"))
    hits = hits.withColumn("worded", F.when((F.size("telling") > 0) & (worded <= min(WORDED, limit)) & ~F.coalesce(full, F.lit(False)), worded - 1))

    def lexical(s: Column) -> Column:
        t = s["t"]
        return F.lit(50.0) - s["i"] * 2 - F.col("worded") + F.when(label == t, 60).when(F.startswith(label, t), 30).when(F.contains(label, t), 18).otherwise(0) + F.when(F.contains(name, t), 12).otherwise(0) + F.when(F.contains(path, t), 6).otherwise(0)

    word_score = F.when(F.col("worded").isNotNull(), F.array_max(F.transform("signals", lexical)))
    exact_score = F.when(F.col("exact"), 240.0 - F.col("at") * 18)
    hits = hits.where(F.col("exact") | F.col("worded").isNotNull() | F.col("found").isNotNull())
    phrase = F.when((F.length(label) >= 4) & F.contains(F.col("asked"), F.trim(label)), 240.0).when((F.length(name) >= 6) & F.contains(F.col("asked"), name), 80.0).otherwise(F.greatest(F.lit(0), F.size("all") - 1) * 80.0)
    score = F.coalesce(F.greatest(exact_score, word_score), F.lit(0.0)) + F.when(F.col("found").isNotNull(), F.greatest(38.0 - F.col("found"), F.lit(12.0))).otherwise(0.0) + F.col("extra") + phrase
    first = F.when(F.size("all") > 0, F.array_position("terms", F.col("all")[0]) - 1)
    out = hits.select("question_id", "id", F.round(score, 6).alias("score"), F.when(F.col("exact"), F.col("at")).otherwise(first).cast("int").alias("anchor"), "label", "qualified")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "qualified", "id"))
    return out.withColumn("place", place).where(F.col("place") <= limit)


def seeds(found: DataFrame) -> DataFrame:
    """The first ``SEEDS`` of the ten best candidates by anchor and score, those of a label seen before last."""
    best = found.where("place <= 10")
    order = [F.coalesce("anchor", F.lit(999)), F.desc("score"), F.col("qualified"), F.col("id")]
    question = Window.partitionBy("question_id")
    again = F.row_number().over(Window.partitionBy("question_id", F.lower("label")).orderBy(*order)) > 1
    nth = F.row_number().over(question.orderBy("again", *order))
    return best.withColumn("again", again).withColumn("nth", nth).where(F.col("nth") <= SEEDS).drop("again")


def transitions(edges: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Every way to go on from ``ends`` (lens, node): lens, src, dst, edge, gain (without the node's own); the first ``FAN`` each way.

    The ends are those of the beams, a bounded few; they go to the edges, which
    stay where they are and are not copied for each lens.
    """
    at = F.broadcast(ends.select("lens", F.col("node").alias("end")))
    sure = edges.where(F.col("confidence").isin(*CERTAIN)).select(F.col("id").alias("edge"), "src", "dst", "type", "confidence")
    kinds = lambda c: nodes.select(F.col("id").alias(c), F.col("kind").alias(f"{c}_kind"))
    out = sure.join(at, F.col("src") == F.col("end")).where(F.col("type").isin(*RUNS, *SUPPORTS, "contains") | F.array_contains(_by_lens(MORE, F.col("lens")), F.col("type"))).join(kinds("src"), "src").join(kinds("dst"), "dst")
    out = out.where((F.col("type") != "contains") | (~F.col("src_kind").isin("file", "project") & F.col("dst_kind").isin("function", "method", "component", "class", "route")))
    rank = F.row_number().over(Window.partitionBy("lens", "src").orderBy(F.col("type") != "calls", "edge"))
    out = out.withColumn("k", rank).where(F.col("k") <= FAN).withColumn("backwards", F.lit(False)).select("lens", "src", "dst", "edge", "type", "confidence", "backwards", "k")
    back = sure.join(at, F.col("dst") == F.col("end")).where(F.col("type").isin(*ENTERS) | F.array_contains(_by_lens(BACKWARDS, F.col("lens")), F.col("type"))).select("lens", F.col("dst").alias("src"), F.col("src").alias("dst"), "edge", "type", "confidence")
    rank = F.row_number().over(Window.partitionBy("lens", "src").orderBy("type", "edge"))
    back = back.withColumn("k", rank).where(F.col("k") <= FAN).withColumn("backwards", F.lit(True)).join(nodes.select(F.col("id").alias("dst")), "dst").select(out.columns)
    gain = edge_score(F.col("type"), F.col("lens"), F.col("backwards")) + F.when(F.col("confidence") == "user_confirmed", CONFIRMED).otherwise(0.0)
    return out.unionByName(back).select("lens", "src", "dst", "edge", gain.alias("gain"))


def _ranked() -> Column:
    """A path's score with what its anchors, terms and length count."""
    return F.col("score") + F.size("anchors") * 70 + F.size("said") * 18 - F.greatest(F.lit(0), F.size("path") - 5) * 3


def flows(questions: DataFrame, nodes: DataFrame, edges: DataFrame, found: DataFrame, steps: int = STEPS) -> DataFrame:
    """(question_id, lens, place, path, edges, score): up to ``PATHS`` paths for each question, from its candidates."""
    q = questions.select("question_id", lens(F.col("query")).alias("lens"), terms(F.col("query")).alias("terms"))
    known = settled(found.select("question_id", F.col("id").alias("node"), F.col("score").alias("own"), "anchor"))
    text = nodes.select(F.col("id").alias("node"), F.concat_ws("\n", *_said("label", "qualified", "path", "signature")).alias("text"), bonus().alias("extra"))
    new_terms = lambda terms_, said, text_: F.filter(terms_, lambda t: ~F.array_contains(said, t) & F.contains(text_, t))
    none = F.array().cast("array<string>")
    s = seeds(found).join(q, "question_id").join(nodes.select("id", "kind"), "id")
    entry = edges.where((F.col("type") == "defines_route") & F.col("confidence").isin(*CERTAIN))
    first = lambda column: Window.partitionBy(column).orderBy("id")
    handler = entry.withColumn("k", F.row_number().over(first("dst"))).where("k = 1").select(F.col("dst").alias("id"), F.col("src").alias("handler"), F.col("id").alias("by_handler"))
    route = entry.withColumn("k", F.row_number().over(first("src"))).where("k = 1").select(F.col("src").alias("id"), F.col("dst").alias("route"), F.col("id").alias("by_route"))
    s = s.join(handler, "id", "left").join(route, "id", "left")
    is_route = (F.col("kind") == "route") & F.col("handler").isNotNull()
    path = F.when(is_route, F.array("id", "handler")).when(F.col("route").isNotNull(), F.array("route", "id")).otherwise(F.array("id"))
    walked = F.when(is_route, F.array("by_handler")).when(F.col("route").isNotNull(), F.array("by_route")).otherwise(F.slice(F.array("by_route"), 1, 0))
    s = s.select("question_id", "lens", "terms", "nth", "score", "anchor", path.alias("path"), walked.alias("walked"))
    ends = s.select("question_id", "nth", F.explode("path").alias("node")).join(text.select("node", "text"), "node").join(known.select("question_id", "node", F.lit(True).alias("anchored"), "anchor").where("anchor is not null"), ["question_id", "node"], "left")
    ends = ends.groupBy("question_id", "nth").agg(F.array_join(F.collect_list("text"), "\n").alias("text"), F.array_sort(F.collect_set(F.when(F.col("anchored"), F.col("node").cast("string")))).alias("anchors"))
    s = s.join(ends, ["question_id", "nth"]).withColumn("said", new_terms(F.col("terms"), none, F.col("text")))
    ahead = F.greatest(F.lit(0), F.size("terms") - F.coalesce("anchor", F.size("terms"))) * 140.0
    live = settled(s.select("question_id", "lens", "terms", "nth", "path", "walked", (F.col("score") + F.size("said") * 8.0 + ahead).alias("score"), "said", "anchors"))
    done, names = None, live.columns

    def keep(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    for _ in range(steps):
        keep(live.where(F.size("path") >= steps))
        going = live.where(F.size("path") < steps)
        ways = settled(transitions(edges, nodes, going.select("lens", F.element_at("path", -1).alias("node")).distinct()))
        met = text.join(F.broadcast(ways.select(F.col("dst").alias("node")).distinct()), "node")  # at most FAN each way of an end
        ways = ways.join(met.withColumnRenamed("node", "dst"), "dst")
        grown = going.join(ways, (going["lens"] == ways["lens"]) & (F.element_at("path", -1) == ways["src"])).drop(ways["lens"]).where(~F.array_contains("path", F.col("dst")))
        grown = grown.join(known.withColumnRenamed("node", "dst"), ["question_id", "dst"], "left")
        grown = grown.withColumn("fresh", new_terms(F.col("terms"), F.col("said"), F.col("text"))).withColumn("meets", F.col("anchor").isNotNull() & ~F.array_contains("anchors", F.col("dst").cast("string")))
        score = F.col("score") + F.col("gain") + F.col("extra") + F.size("fresh") * 26.0 + F.when(F.col("meets"), 90.0 + F.col("own") * 0.75).otherwise(0.0)
        grown = settled(grown.select(
            "question_id", "lens", "terms", "nth", F.col("path").alias("before"), F.col("walked").alias("walked_before"), F.concat("path", F.array("dst")).alias("path"), F.concat("walked", F.array("edge")).alias("walked"), score.alias("score"),
            F.concat("said", "fresh").alias("said"), F.when(F.col("meets"), F.array_sort(F.concat("anchors", F.array(F.col("dst").cast("string"))))).otherwise(F.col("anchors")).alias("anchors"), (F.col("meets") & (F.size("said") + F.size("fresh") >= 2)).alias("over"),
        ))
        keep(grown.where("over").select(names))
        onward = grown.where("not over")
        stuck = going.join(onward.select("question_id", "nth", F.col("before").alias("path"), F.col("walked_before").alias("walked")).distinct(), ["question_id", "nth", "path", "walked"], "left_anti")
        keep(stuck.select(names))
        rank = F.row_number().over(Window.partitionBy("question_id", "nth").orderBy(F.desc(F.round(_ranked(), 6)), "path", "walked"))
        live = settled(onward.select(names).withColumn("r", rank).where(F.col("r") <= BEAM).drop("r"))
        if live.isEmpty():
            break
    keep(live)
    ranked = settled(done).where(F.size("walked") > 0).withColumn("ranked", F.round(_ranked(), 6))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "nth").orderBy(F.desc("ranked"), "path", "walked"))).where(F.col("r") <= OF_SEED)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("question_id", "path").orderBy(F.desc("score"), "walked", "nth"))).where("r = 1")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("ranked"), "path"))
    return ranked.withColumn("place", place).where(F.col("place") <= PATHS).select("question_id", "lens", "place", "path", F.col("walked").alias("edges"), F.col("ranked").alias("score"))
