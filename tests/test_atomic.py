"""Packs and contracts of compiled facts on small inputs."""

from pyspark.sql import functions as F

from quillspark.operators import atomic as K
from quillspark.operators import atoms as A

TURN = "session_id string, date string, turn int, role string, text string"


def run(spark, question, turns, budget=2000, ranks=None):
    rows = [(s, d, t, r, x) for s, d, t, r, x in turns]
    facts, _ = A.compiled(spark.createDataFrame(rows, TURN))
    facts = facts.withColumn("owner", F.lit(1))
    asked = spark.createDataFrame([(7, 1, question)], "question_id int, owner int, question string")
    order = ranks or list(dict.fromkeys(s for s, *_ in turns))
    r = spark.createDataFrame([(7, s, k) for k, s in enumerate(order)], "question_id int, session_id string, rank int")
    p = K.packed(K.scored(asked, facts, r), budget)
    got = p.orderBy("place").collect()
    contract = K.contracts(p).collect()
    return got, contract[0] if contract else None


HISTORY = [
    ("a", "2024-01-02", 0, "user", "I now own 3 lamps."), ("a", "2024-01-02", 1, "assistant", "Nice lamps. You could sell one."), ("b", "2024-02-03", 0, "user", "I now own 5 lamps.\nThe weather is fine."), ("b", "2024-02-03", 1, "user", "My cat sleeps."), ("c", "2024-03-04", 0, "assistant", "Rain again."),
]


def test_sessions_first_then_anchors_then_neighbours(spark):
    got, contract = run(spark, "How many lamps do I own now?", HISTORY)
    assert contract.operation == "current_state" and contract.safe and contract.missing == []
    assert [x.stage for x in got] == sorted(x.stage for x in got) and all(x.taken for x in got)
    heads = [x for x in got if x.stage == 0]
    assert [x.session_id for x in heads] == ["a", "b", "c"] and [x.speaker for x in heads] == ["user", "user", "assistant"]
    assert {x.id for x in got if x.stage == 3} == {"b-t0-u1"} or "b-t0-u1" in {x.id for x in got if x.stage in (0, 1, 3)}
    assert got[-1].stage == 4


def test_no_fact_exceeds_the_budget_and_smaller_ones_still_fit(spark):
    got, contract = run(spark, "How many lamps do I own now?", HISTORY, budget=45)
    used = 0
    for x in got:
        if x.stage in (0, 1, 2, 3, 4):
            assert x.taken == (used + x.cost <= 45)
            used += x.cost * x.taken
    assert used <= 45 and not contract.safe and "operation-required candidate facts were dropped" in contract.reasons
    none, contract = run(spark, "How many lamps do I own now?", HISTORY, budget=1)
    assert not any(x.taken for x in none) and "retrieved sessions received no evidence allocation" in contract.reasons


def test_only_retrieved_sessions_count(spark):
    got, _ = run(spark, "How many lamps do I own now?", HISTORY, ranks=["b"])
    assert {x.session_id for x in got} == {"b"} and {x["rank"] for x in got} == {0}


def test_contracts(spark):
    def missing(question, texts, **kw):
        turns = [(f"s{k}", f"2024-0{k + 1}-02", 0, "user", x) for k, x in enumerate(texts)]
        return run(spark, question, turns, **kw)[1]

    moved = missing("Has where I live changed, from which town?", ["I live in Rome town.", "I moved to Oslo town."])
    assert moved.operation == "state_comparison" and moved.missing == [] and moved.safe
    loose = missing("Has where I live changed, from which town?", ["I used to live in Rome town.", "I moved to Oslo town."])
    assert loose.missing == ["normalized_state_identity"]  # a unit that only says "used to" has no key
    order = missing("List my trips in order", ["I visited a trip fair on 2024-01-05.", "I attended trip talks on 2024-02-01."])
    assert order.operation == "event_order" and order.missing == []
    days = missing("How long between the trips?", ["I visited a trip fair on 2024-01-05."])
    assert days.operation == "temporal_difference" and days.missing == ["start_date", "end_date"]
    count = missing("How many castles did I see?", ["I visited 4 castles."])
    assert count.operation == "distinct_count" and count.missing == [] and count.safe
    open_ = missing("Which places did I see?", ["I visited nice places."])
    assert open_.operation == "aggregate_list" and "closed_world_category_coverage" in open_.missing
    total = missing("What is the total price I paid for boxes?", ["I paid 5 dollars for boxes.", "I paid 7 euros for boxes."])
    assert total.operation == "numeric_sum" and total.missing == ["compatible_units"]
    assert missing("Who paid?", ["I paid."]).missing == ["unsupported_operation"]


def test_no_facts(spark):
    assert run(spark, "How many?", [("a", "2024-01-01", 0, "system", "x")]) == ([], None)
