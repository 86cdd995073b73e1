"""Queries that normalize memories proposed of customers; what of them holds is known from how they are rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as N
from ..sources.tables import load
from .compiled import _cases, _quoted
from .registry import query

#: Turns of a customer's session ({c} name, {n} nation, {m} a number, {s} segment), and what is proposed of them.
TURNS = (
    (0, "user", "{c} of {n} ordered {m} crates. The buyer also wrote a  report on {s}."),
    (1, "assistant", "{n} might need {m} trucks."),
    (2, "user", "As said:\n| part | price |\n|---|:---:|\n| bolt {m} | {m} |\n| | 3 |\nThe end"),
    (3, "system", "Not for {c}."),
)
#: mention, surface, kind, alias of, turn, excerpt, category.
MENTIONS = (
    ("m0", "{c}", "organization", None, 0, "of {n}", None), ("m0", "{c}", "organization", None, 0, "{c} of {n}", "Big Buyer"), ("m1", "The buyer", "organization", "m0", 0, "The buyer also", "buyer"), ("m0", "{n}", "place", None, 0, "of {n}", None),
    ("m2", "{n}", "place", None, 1, "{n} might", None), ("m3", "report", "document", "m2", 0, "wrote a  report", None), ("m4", "a report", "document", "m9", 0, "wrote a  report on", None), ("m5", "{c}", "organization", None, 3, "{c}", None),
    ("m6", "{c}", "organization", None, 7, "{c}", None), ("m7", "{n}", "place", None, 0, "of {n}!", None), ("m8", "buyer", "organization", "m1", 0, "buyer", None),
)
#: event, type, status, same as, turn, excerpt.
EVENTS = (
    ("e0", "Ordered  Goods!", "completed", None, 0, "{c} of {n} ordered {m} crates"), ("e1", "purchase", "completed", "e0", 0, "ordered {m} crates"), ("e0", "again", "completed", None, 0, "ordered"), ("e2", "need", "completed", None, 1, "might need {m}"), ("e3", "need", "planned", None, 1, "might need {m} trucks"),
    ("e4", "lost", "completed", "e9", 0, "ordered"), ("e5", "wrote", "completed", None, 0, "wrote a  report"), ("e6", "wrote", "completed", None, 0, "The buyer also wrote"), ("e7", "gone", "planned", None, 8, "x"),
)
#: event, place, role, entity, literal.
PARTICIPANTS = (("e0", 0, "Agent", "m1", None), ("e0", 1, "item", None, "{m}  Crates"), ("e1", 0, "agent", "user", None), ("e3", 0, "who", "m2", None), ("e5", 0, "agent", "m5", None), ("e5", 1, "item", None, "letter"), ("e6", 0, "item", None, "letter"), ("e6", 1, "agent", "m5", None))
AMOUNTS = (("e0", 2.5, "Crates", "Ordered amount"), ("e3", 4.0, "trucks", ""))
#: relation, subject, predicate, object, text, mode, scope, turn, excerpt.
RELATIONS = (
    ("r0", "m1", "Located in", "m2", None, "asserted", "home base", 0, "{c} of {n}"), ("r1", "m2", "needs", None, "trucks", "asserted", None, 1, "might need {m} trucks"), ("r2", "m2", "needs", None, "TRUCKS", "hypothetical", None, 1, "might need {m} trucks"),
    ("r3", "m7", "has", None, "report", "asserted", None, 0, "a  report"), ("r4", "m0", "has", "m5", None, "asserted", None, 0, "a  report"), ("r5", "m0", "has", None, "letter", "asserted", None, 0, "a  report"), ("r6", "user", "told of", None, "A report", "asserted", "", 0, "wrote a  report"), ("r0", "m0", "x", None, "report", "asserted", None, 0, "a  report"),
)
SIGNATURES = (
    "entity|{c}|organization", "category|{c}|big_buyer", "category|{c}|buyer", "alias|{c}|{c}", "alias|{c}|the buyer", "alias|{c}|buyer", "entity|{n}|place", "alias|{n}|{n}", "entity|report|document", "alias|report|report", "entity|a report|document", "alias|a report|a report",
    "event|ordered_goods|completed", "event|purchase|completed", "event|need|planned", "event_participant|ordered_goods|completed|agent|{c}", "event_participant|ordered_goods|completed|item|{m} crates", "event_participant|purchase|completed|agent|user", "event_participant|need|planned|who|{n}",
    "quantity|event|ordered_goods|ordered_amount|2.5|crates", "quantity|event|need|unknown|4|trucks", "relation|located_in|{c}|{n}|asserted", "supersession|located_in|{c}", "relation|needs|{n}|trucks|hypothetical", "relation|told_of|user|a report|asserted", "table|bolt {m}|price|{m}",
)
REJECTED = {
    "citation_role_invalid": 1, "citation_turn_out_of_range": 2, "citation_excerpt_not_exact": 1, "entity_surface_not_in_citation": 1, "duplicate_mention_id": 1, "alias_reference_missing": 1, "alias_kind_mismatch": 1, "duplicate_event_id": 1, "completed_event_not_supported_by_modality": 1,
    "event_identity_reference_missing": 1, "event_participant_reference_missing": 1, "event_literal_not_in_citation": 1, "asserted_relation_not_supported_by_modality": 1, "relation_subject_reference_missing": 1, "relation_object_reference_missing": 1, "relation_literal_not_in_citation": 1, "duplicate_relation_id": 1,
}


def _tables(spark, d):
    people = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select(F.col("c_custkey").alias("session_id"), *(v.alias(k) for k, v in (("c", F.col("c_name")), ("n", F.col("n_name")), ("m", (F.col("c_custkey") % 90 + 10).cast("string")), ("s", F.lower("c_mktsegment")))))

    def rendered(rows, ddl: str):
        names = [x.split()[0] for x in ddl.split(", ")]
        many = F.array(*(F.struct(F.lit(k).alias("nth"), *(F.lit(x).alias(n) for n, x in zip(names, row))) for k, row in enumerate(rows)))
        got = people.withColumn("r", F.explode(many))

        def filled(name: str, kind: str):
            value = F.col(f"r.{name}").cast(kind)
            for mark in "cnms" if kind == "string" else "":
                value = F.replace(value, F.lit("{" + mark + "}"), F.col(mark))
            return value.alias(name)

        return got.select("session_id", "r.nth", *(filled(*x.split()) for x in ddl.split(", ")))

    turns = rendered(TURNS, "turn int, role string, text string").drop("nth")
    mentions = rendered(MENTIONS, "mention_id string, surface string, kind string, alias_of string, turn int, excerpt string, category string")
    mentions = mentions.withColumn("categories", F.array_compact(F.array("category"))).drop("category")
    events = rendered(EVENTS, "event_id string, type string, status string, same_as string, turn int, excerpt string").withColumns({"event_date": F.lit("2024-01-01"), "confidence": F.lit(0.9)})
    participants = rendered([(e, r, ref, lit) for e, _, r, ref, lit in PARTICIPANTS], "event_id string, role string, entity_ref string, literal string")
    amounts = rendered(AMOUNTS, "event_id string, value double, unit string, role string").drop("nth")
    relations = rendered(RELATIONS, "relation_id string, subject_ref string, predicate string, object_ref string, object_text string, mode string, scope string, turn int, excerpt string").withColumns({"valid_from": F.lit(None).cast("string"), "confidence": F.lit(0.9)})
    return N.normalized(turns, mentions, events, participants, amounts, relations, N.proposed_cells(turns), roles=("user", "assistant"))


_PEOPLE = "p as (select c_custkey as session_id, lower(c_name) as c, lower(n_name) as n, cast(c_custkey % 90 + 10 as varchar) as m from customer join nation on c_nationkey = n_nationkey)"


@query(f"""with {_PEOPLE}, {_cases([(s,) for s in SIGNATURES], "s", "sig")} select session_id, replace(replace(replace(sig, '{{c}}', c), '{{n}}', n), '{{m}}', m) as signature from p cross join s""")
def m08_signatures(spark, d):
    """What each customer's session says once normalized: entities, events, amounts, relations, cells."""
    return N.signatures(_tables(spark, d))


@query(f"""with {_PEOPLE}, {_cases(list(REJECTED.items()), "r", "why", "n")} select session_id, why, cast(r.n as bigint) as n from p cross join r""")
def m08_rejections(spark, d):
    """How many proposals of each session its turns do not bear out, by reason."""
    return _tables(spark, d)["rejected"]


@query(f"""with {_PEOPLE}, k as (select *, regexp_replace(c, '[^a-z0-9]+', '_', 'g') as ck, regexp_replace(n, '[^a-z0-9]+', '_', 'g') as nk from p)
select session_id, entity, aliases, mentions, identities, events, relations from (select session_id, unnest(['entity:organization:' || ck, 'entity:place:' || nk, 'entity:document:report', 'entity:document:a_report']) as entity,
  unnest([3, 1, 1, 1]) as aliases, unnest(['m0,m1,m8', 'm2', 'm3', 'm4']) as mentions from k) cross join (select 2::bigint as identities, 3::bigint as events, 3::bigint as relations)""")
def m08_entities(spark, d):
    """Entities with their aliases and mentions, beside how many events, identities of events and relations their session keeps."""
    t = _tables(spark, d)
    e = t["entities"].select("session_id", F.col("entity_key").alias("entity"), F.size("aliases").alias("aliases"), F.array_join("mentions", ",").alias("mentions"))
    v = t["events"].groupBy("session_id").agg(F.count_distinct("event_identity_key").alias("identities"), F.count_distinct("event_key").alias("events"))
    r = t["relations"].groupBy("session_id").agg(F.count_distinct("relation_key").alias("relations"))
    return e.join(v, "session_id").join(r, "session_id")
