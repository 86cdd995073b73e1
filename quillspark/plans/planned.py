"""Queries that plan customers' questions in full: operation, slots, scope, targets, confidence and path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import planner as P
from ..sources.tables import load
from .compiled import _cases
from .registry import query

#: A question, and what it is planned to be: operation, targets, aliases, counted things, scope, slots, confidence.
ASKED = (
    ("How long did the crates take?", "temporal_difference", "crat long take", "", "", "any", "start_date end_date", 0.96),
    ("How many days ago did I see my doctor?", "temporal_difference", "ago days doctor see", "clinician physician", "ago days", "user", "start_date end_date", 0.96),
    ("What was the average price of your boxes?", "numeric_average", "boxe price", "", "", "assistant", "complete_numeric_set compatible_units", 0.97),
    ("What is the total I spent on parties?", "numeric_sum", "party spent", "", "", "user", "complete_numeric_set compatible_units", 0.94),
    ("How much more is a bolt?", "numeric_difference", "bolt more much", "", "", "any", "left_value right_value compatible_units", 0.94),
    ("Has the status changed?", "state_comparison", "status", "", "", "any", "previous_state current_state", 0.93),
    ("Do I owe more money than before?", "state_comparison", "money more owe", "", "", "any", "previous_state current_state", 0.93),
    ("List my trips in order", "event_order", "order trip", "", "", "any", "dated_event_set", 0.9),
    ("When was the first visit?", "event_order", "visit", "", "", "any", "dated_event_set", 0.9),
    ("Where is the latest crate?", "current_state", "crate", "", "", "any", "current_state state_history_checked", 0.88),
    ("How many online orders have I made?", "distinct_count", "made online order", "", "order", "user", "complete_candidate_set deduplication_key", 0.91),
    ("Which places are in common?", "aggregate_list", "common plac", "", "", "any", "complete_candidate_set session_coverage", 0.86),
    ("Who paid?", "direct_lookup", "paid", "", "", "any", "answer_fact", 0.9),
)
_ROWS = [(k, *a[1:]) for k, a in enumerate(ASKED)]


@query(
    f"""with {_cases(_ROWS, "a", "k", "operation", "targets", "aliases", "counted", "scope", "slots", "confidence")}, s as (select o_custkey, count(distinct year(o_orderdate)) as sessions from orders group by 1)
select c_custkey, operation, targets, aliases, counted, scope, slots, a.confidence, case when operation = 'direct_lookup' or operation = 'aggregate_list' and coalesce(sessions, 0) < {P.SESSIONS} then 'claim-first' else 'atomic' end as path
from customer join a on k = c_custkey % {len(ASKED)} left join s on o_custkey = c_custkey"""
)
def f17_atomic_plans(spark, d):
    """The plan of each customer's question, and its path by how many sessions the customer has."""
    sessions = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct(F.year("o_orderdate")).alias("sessions"))
    asked = F.element_at(F.array(*(F.lit(a[0]) for a in ASKED)), (F.col("c_custkey") % len(ASKED)).cast("int") + 1)
    # a question is few bytes and much work: dealt out, and planned before the join, whose tasks are dealt by bytes
    customers = load(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    rows = customers.select("c_custkey", P.plan(asked).alias("p")).join(sessions, "c_custkey", "left")
    listed = (F.array_join(f"p.{c}", " ").alias(c) for c in ("targets", "aliases", "counted"))
    return rows.select("c_custkey", "p.operation", *listed, "p.scope", F.array_join("p.slots", " ").alias("slots"), "p.confidence", P.route(F.col("p"), F.coalesce("sessions", F.lit(0)))["path"].alias("path"))
