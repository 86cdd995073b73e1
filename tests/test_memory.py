"""Compiled facts, typed answers and packed claims on small inputs, against plain Python."""

import datetime
import math
import re

from pyspark.sql import functions as F

from quillspark.functions import quantities as Q
from quillspark.functions import statements as S
from quillspark.operators import atoms as A
from quillspark.operators import consolidate as O
from quillspark.operators import typed as Y

TURN = "session_id string, date string, turn int, role string, text string"


def test_quantities():
    def read(text):
        return [(q["value"], q["unit"], q["role"], text[q["begins"] : q["ends"]]) for q in Q.quantities(text)]

    assert read("Paid €1,250.50 and 3% of two hundred and five miles") == [(1250.5, "euros", "mentioned_quantity", "1,250.50"), (3, "percent", "mentioned_quantity", "3"), (205, "miles", "mentioned_quantity", "two hundred and five")]
    assert read("x12 1.2.3 and, and") == [] and read("-4 dozen") == [(-4, "number", "mentioned_quantity", "-4"), (12, "number", "mentioned_quantity", "dozen")]
    assert read("We now own 4 old houses in town") == [(4, "hous", "declared_cardinality", "4")]
    assert read("My mom is sixty") == [(60, "years", "mentioned_quantity", "sixty")] and read("in the 1990s") == [(1990, "number", "mentioned_quantity", "1990s")]
    one = Q.quantities("I paid 5; but then 6, while it rained")
    assert [q["context"] for q in one] == ["I paid 5", "then 6"]
    assert Q.quantities(None) == [] and Q.quantities("") == []


def test_first_of_each_keeps_order(spark):
    rows = [(["b", "A", "a", "B", "c", None],), ([],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<string>").select(S.first_of_each(F.col("x"), lambda v: F.lower(v))).collect()]
    assert got[0] == ["b", "A", "c", None] and got[1] == [] and got[2] is None


def test_units_are_bounded_and_unlike(spark):
    long = "Word one. " * 40
    rows = [("- a\n\n  - A \nplain  line\nPLAIN line\n| x | y |\n|---|\n***",), (long,), ("z" * 3000,), (None,), (" \t\n",), ("a b\x1cc",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(A.units(F.col("t"))).collect()]
    assert got == [["- a", "plain  line", "| x | y |"], ["Word one."], ["z" * 1200, "z" * 600], [], [], ["a", "b", "c"]]


def test_facts_stand_in_their_turns_and_cover_every_unit(spark):
    rows = [
        ("s1", "2024-03-09", 0, "user", "I moved to Rome yesterday. I have 3 cats!\nDr. May Lee called"), ("s1", "2024-03-09", 1, "assistant", "Try the park."), ("s1", "2024-03-09", 2, "user", None),
        ("s2", None, 0, "user", "I bought a new cat on 2024-02-30."), ("s2", None, 1, "other", "I have 9 cats."),
    ]
    facts, coverage = A.compiled(spark.createDataFrame(rows, TURN))
    facts, coverage = facts.collect(), coverage.collect()
    texts = {(r[0], r[2]): r[4] for r in rows}
    assert all(f.excerpt in texts[f.session_id, f.turn] for f in facts)
    assert len({f.id for f in facts}) == len(facts)
    assert sorted((c.session_id, c.turn, c.unit) for c in coverage) == [("s1", 0, 0), ("s1", 0, 1), ("s1", 1, 0), ("s2", 0, 0)]
    assert all(c.fact_ids and set(c.fact_ids) <= {f.id for f in facts} for c in coverage)
    by = {(f.session_id, f.turn, f.predicate): f for f in facts}
    assert by["s1", 0, "lives_in"].event_date == datetime.date(2024, 3, 8) and by["s1", 0, "lives_in"].object == "Rome"
    assert by["s1", 0, "category_member"].object == "Dr. May Lee" and by["s1", 1, "suggested_option"].kind == "recommendation"
    assert by["s2", 0, "counter_delta"].quantity.unit == "cat" and by["s2", 0, "completed_action"].event_date is None
    assert [f for f in facts if f.session_id == "s2" and f.turn == 1] == []


def test_counters(spark):
    rows = [("a", "2024-01-02", 0, "user", "I have 3 lamps."), ("a", "2024-01-03", 0, "user", "I just bought a lamp."), ("b", "2024-01-04", 1, "user", "I bought one new lamp!"), ("c", "2024-01-01", 0, "user", "I added a lamp."), ("c", "2024-01-01", 1, "user", "I opened a shop in town.")]
    facts, _ = A.compiled(spark.createDataFrame(rows, TURN))
    got = {r.category: (r.held, r.added, r.current) for r in A.counters(facts.withColumn("owner", F.lit(1)), "owner").collect()}
    assert got == {"lamp": (3.0, 2.0, 5.0), "shop": (None, 1.0, 1.0)}


def test_compiling_no_turns(spark):
    facts, coverage = A.compiled(spark.createDataFrame([], TURN))
    assert facts.count() == 0 and coverage.count() == 0


RECORD = (
    "owner int, session_id string, date date, claim_id string, excerpt string, mode string, negated boolean, subject string, predicate string, object string, object_type string, topic string, tags array<string>, "
    "confidence double, numeric struct<value:double,unit:string,role:string,context:string>, status string"
)


def record(claim, owner=1, session="s", day=1, excerpt="", mode="completed", negated=False, subject="user", object_="x", kind="text", topic=None, tags=(), sure=0.9, numeric=None, status="current"):
    return (owner, session, datetime.date(2025, 1, day), claim, excerpt, mode, negated, subject, "p", object_, kind, topic, list(tags), sure, numeric, status)


def answers(spark, question, rows, **kw):
    asked = spark.createDataFrame([(7, 1, question)], "question_id int, owner int, question string")
    return Y.answered(asked, spark.createDataFrame(rows, RECORD), **kw).collect()[0]


def test_distinct_count_leaves_out_what_is_not_done(spark):
    rows = [
        record("orange", object_="orange", kind="citrus_fruit"), record("lime", object_="lime", kind="citrus_fruit"), record("sangria", object_="sangria_with_orange_and_lemon", kind="cocktail", excerpt="I served Sangria with slices of orange and lemon."),
        record("plan", mode="planned", object_="grapefruit", kind="citrus_fruit"), record("not", negated=True, object_="yuzu", kind="citrus_fruit"), record("unsure", object_="pomelo", kind="citrus_fruit", sure=0.4), record("other", owner=2, object_="kumquat", kind="citrus_fruit"),
    ]
    got = answers(spark, "How many different types of citrus fruits have I used?", rows)
    assert (got.intent, got.status, got.answer, got.required) == ("distinct_count", "resolved", "3: lemon, lime, orange.", ["lime", "orange", "sangria"])
    cut = answers(spark, "How many different types of citrus fruits have I used?", rows, scan=5)
    assert cut.status == "fallback" and cut.reason == Y.REASONS["truncated"] and cut.answer is None


def test_comparison_matches_role_context_and_unit(spark):
    ratio = lambda v: (v, "oz_per_tbsp", "ratio", "french_press_water")
    rows = [record("new", day=9, numeric=ratio(5.0)), record("old", day=2, numeric=ratio(6.0)), record("price", day=3, numeric=(20.0, "usd", "price", "coffee"))]
    got = answers(spark, "Did I switch to more or less water?", rows)
    assert (got.status, got.answer, got.required) == ("resolved", "Less: from 6 to 5 oz per tbsp.", ["old", "new"])
    assert answers(spark, "Did I switch to more or less water?", rows[1:]).status == "fallback"


def test_preferences_of_topics_subjects_and_histories(spark):
    pref = {"mode": "current", "tags": ("preference",)}
    rows = [record("tea1", day=1, topic="tea", object_="tea", status="superseded", **pref), record("tea2", day=5, topic="tea", object_="tea", **pref), record("rain", day=4, topic="rain", object_="rain", **pref), record("ann", day=6, subject="Ann_Lee", topic="tea", object_="green tea", **pref)]
    assert answers(spark, "What are my preferences?", rows).required == ["tea2", "rain"]
    assert answers(spark, "What are my preferences for tea?", rows).required == ["tea2"]
    assert answers(spark, "How have my preferences for tea changed?", rows).required == ["tea2", "tea1"]
    assert answers(spark, "What are Ann Lee's preferences?", rows).required == ["ann"]
    assert answers(spark, "What are my preferences for wine?", rows).status == "fallback"


def test_advice_needs_an_experience_and_another_interest(spark):
    did, want = ("demonstrated_experience",), ("stated_goal_or_interest",)
    stew = record("stew", session="a", excerpt="I made beef stew", tags=did)
    assert answers(spark, "Recommend a stew for dinner", [stew]).status == "fallback"
    both = answers(spark, "Recommend a stew for dinner", [stew, record("yogurt", session="b", mode="goal", excerpt="I want stew", tags=want), record("more", session="b", day=3, excerpt="stew again", mode="current")])
    assert (both.status, both.required, both.supporting) == ("needs_generation", ["stew", "yogurt"], ["more"])
    alone = answers(spark, "Recommend a stew", [record("one", excerpt="I made stew", tags=did + want)])
    assert alone.status == "fallback" and alone.reason == Y.REASONS["collapsed"]


def test_answers_without_evidence(spark):
    got = answers(spark, "Where is it?", [])
    assert (got.intent, got.status, got.confidence) == ("unsupported", "fallback", 0.0)
    assert answers(spark, "What should I do?", []).reason == Y.REASONS["personalized_advice"]


def estimate(text):
    text = " ".join(text.split())
    return max(1, len(text) // 4, math.ceil(round(len(re.findall(r"\w+|[^\w\s]", text)) * 1.15, 6)))


def test_trimming_takes_the_lowest_scored_claims_until_the_packet_fits(spark):
    r = [(1, f"s{i % 3}", datetime.date(2024, 1, 1 + i % 3), i % 3, i, 0, "user", "w" * (3 + i % 7) + f" {i} fine, é", "completed", "unknown", "none", ["t"] if i in (1, 5, 9) else [], ["positive"] if i % 2 else ["negative"], float(i * 7 % 11), "session_coverage" if i < 3 else "ranked_claim", i, True) for i in range(12)]
    schema = "question_id int, session string, date date, rank int, turn int, sentence int, speaker string, text string, mode string, number_role string, event_role string, topics array<string>, polarities array<string>, score double, reason string, place long, taken boolean"
    taken = spark.createDataFrame(r, schema)
    found = O.groups(taken)
    for budget in (60, 120, 150, 200, 1000):
        rows = O.trimmed(taken, found, budget)
        kept = {x.turn for x in rows.where("kept").collect()}
        packet = O.packets(rows, found).collect()[0]
        index = "\n".join(x.said for x in O.index_lines(taken, found).orderBy("nth").collect())

        def shown(turns):
            out, head = [], None
            for t in sorted((x for x in r if x[4] in turns), key=lambda x: (x[2], x[1], x[4])):
                if (t[1], t[2]) != head:
                    head = (t[1], t[2])
                    out.append(f"Session {t[1]} — {t[2]}")
                out.append(f"- [user turn {t[4]} sentence 0] {{completed}} {t[7]}")
            return index + "\n" + "\n".join(out)

        want, going = {x[4] for x in r}, sorted((x for x in r if x[4] > 2), key=lambda x: (x[13], -x[15]))
        while estimate(shown(want)) > budget and going:
            want.discard(going.pop(0)[4])
        assert kept == want and packet.packed_tokens >= estimate(packet.packet) - 1
        assert packet.claims == len(want) and packet.packet.count("Session ") == len({x[1] for x in r if x[4] in want})
