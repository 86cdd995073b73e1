"""Column functions that plan a question once: a struct that retrieval, packing and reducers read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantities import CATEGORIES, ENDINGS, KEEPS_S
from .quantities import canonical as canonical_word
from .statements import squeezed
from .text import bound

#: Words that are no terms, and those that only say what to do.
STOP = "a an and are as at be did do does for from had has have how i in is it me my of on or that the to was were what when where which who with you your".split()
DOES = (
    "all average before between change changed compare compared current currently decrease decreased difference distinct earliest elapsed first former formerly how increase increased latest list many most now "
    "number old older over previous previously recent recently than reduced raised sum total used versus what when which"
).split()
ACTS = sorted({canonical_word(w) for w in DOES})
#: Operation, patterns that a question has to have, slots to be filled, confidence, reason; the first match wins.
RULES = (
    ("temporal_difference", (r"\b(how long|elapsed|time between|days? between|weeks? between|months? between|years? between|how many (?:days?|weeks?|months?|years?)(?: ago| before| after| since)?)\b",), ("start_date", "end_date"), 0.96, "elapsed-time operation"),
    ("numeric_average", (r"\baverage|mean\b",), ("complete_numeric_set", "compatible_units"), 0.97, "numeric average operation"),
    ("numeric_sum", (r"\b(sum|total|combined)\b", r"\b(how much|amount|cost|price|spent|distance|time|number|total)\b"), ("complete_numeric_set", "compatible_units"), 0.94, "numeric sum operation"),
    ("numeric_difference", (r"\b(how much (?:more|less)|difference|gap|older than|younger than|increase by|decrease by)\b",), ("left_value", "right_value", "compatible_units"), 0.94, "numeric difference operation"),
    ("state_comparison", (r"\b(chang(?:e|ed)|increase(?:d)?|decrease(?:d)?|raised?|reduced?|went from|moved from|switched from|compared (?:with|to)|before versus now|old (?:and|versus) new|used to|no longer)\b",), ("previous_state", "current_state"), 0.93, "state transition/comparison operation"),
    ("state_comparison", (r"\b(up or down|more or less than before|(?:more|less)\b.+\bthan before)\b",), ("previous_state", "current_state"), 0.93, "state transition/comparison operation"),
    ("event_order", (r"\b(chronological(?:ly)?|in order)\b",), ("dated_event_set",), 0.9, "event ordering operation"),
    ("event_order", (r"\b(earliest|latest|first|most recent(?:ly)?)\b", r"\b(event|happen|occur|visit|trip|appointment|purchase|attend|start|finish|flight|flew|travel)\w*\b"), ("dated_event_set",), 0.9, "event ordering operation"),
    ("current_state", (r"\b(current|currently|now|latest|most recent|present|as of today)\b",), ("current_state", "state_history_checked"), 0.88, "current-state operation"),
    ("distinct_count", (r"\b(how many|number of|count(?: of)?)\b",), ("complete_candidate_set", "deduplication_key"), 0.91, "distinct-count operation"),
    ("aggregate_list", (r"\b(list|all|every|which ones|(?:what|which) (?:activities|items|places|people|things|events)|in common|across (?:\w+\s+){0,2}(?:sessions|conversations|months|years))\b",), ("complete_candidate_set", "session_coverage"), 0.86, "cross-source aggregation operation"),
)
LOOKUP = ("direct_lookup", ("answer_fact",), 0.9, "no multi-fact reasoning contract detected")
COUNTED = r"\b(?:how many|number of)\s+(.+?)\s+(?:am|are|did|do|does|had|has|have|in|on|were|was)\b"
#: Operations that name what is counted, and words that don't; confidence and sessions that the atomic path takes.
COUNTS, NOT_COUNTED = ("temporal_difference", "numeric_average", "numeric_sum", "numeric_difference", "distinct_count"), ("online", "recent", "total")
SURE, SESSIONS = 0.8, 2


def canonical(word: Column) -> Column:
    """A word without case and ending, as ``quantities.canonical``."""
    low, out = F.lower(word), F
    for ending in ENDINGS:
        fits = low.endswith(ending) & (F.length(low) - len(ending) > 3)
        if ending == "s":
            fits = fits & ~low.rlike(f"({'|'.join(KEEPS_S)})$")
        cut = F.substring(low, F.lit(1), F.length(low) - len(ending))
        out = out.when(fits, F.concat(cut, F.lit("y")) if ending == "ies" else cut)
    return out.otherwise(low)


def _terms(text: Column) -> Column:
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: (F.length(w) > 2) & ~w.isin(STOP))
    return F.sort_array(F.array_except(F.transform(words, canonical), F.array(*map(F.lit, ACTS))))


def plan(question: Column) -> Column:
    """operation, targets, aliases, counted, scope, slots, eligible, confidence and reason of a question."""

    def read(low: Column) -> Column:
        chosen = F
        for name, patterns, slots, sure, reason in RULES:
            hit = F.lit(True)
            for p in patterns:
                hit = hit & low.rlike(p)
            chosen = chosen.when(hit, F.struct(F.lit(name).alias("operation"), F.array(*map(F.lit, slots)).alias("slots"), F.lit(True).alias("eligible"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason")))
        name, slots, sure, reason = LOOKUP
        chosen = chosen.otherwise(F.struct(F.lit(name).alias("operation"), F.array(*map(F.lit, slots)).alias("slots"), F.lit(False).alias("eligible"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason")))
        scope = F.when(low.rlike(r"\b(i|me|my|mine)\b"), "user").when(low.rlike(r"\b(you|your)\b"), "assistant").otherwise("any")
        counted = F.filter(_terms(F.regexp_extract(low, COUNTED, 1)), lambda w: ~w.isin(*NOT_COUNTED))
        kinds = F.map_from_arrays(F.array(*map(F.lit, CATEGORIES)), F.array(*map(F.lit, CATEGORIES.values())))

        def finished(c: Column, own: Column, others: Column) -> Column:
            names = c["operation"].isin(*COUNTS)
            return F.struct(
                c["operation"].alias("operation"), own.alias("targets"), F.array_sort(others).alias("aliases"), F.when(names, counted).otherwise(F.array().cast("array<string>")).alias("counted"), F.when(names, scope).otherwise("any").alias("scope"),
                c["slots"].alias("slots"), c["eligible"].alias("eligible"), c["confidence"].alias("confidence"), c["reason"].alias("reason"),
            )

        def named(own: Column) -> Column:
            meant = F.array_compact(F.transform(own, lambda w: F.element_at(kinds, w)))
            alike = lambda m: F.filter(F.array(*map(F.lit, CATEGORIES)), lambda w: F.array_contains(m, F.element_at(kinds, w)) & ~F.array_contains(own, w))
            others = bound(meant, lambda m: F.when(F.size(m) > 0, alike(m)).otherwise(F.array().cast("array<string>")))
            return bound(chosen, lambda c: finished(c, own, others))

        return bound(_terms(low), named)

    return bound(F.lower(squeezed(question)), read)


def route(planned: Column, sessions: Column) -> Column:
    """path and reason: whether a planned question goes by atomic facts or claims first."""
    few = (planned["operation"] == "aggregate_list") & (sessions < SESSIONS)
    path = F.when(planned["eligible"] & (planned["confidence"] >= SURE) & ~few, "atomic").otherwise("claim-first")
    reason = F.when(planned["eligible"] & (planned["confidence"] < SURE), "query-plan confidence below atomic threshold").when(planned["eligible"] & few, "aggregation has fewer than two retrieved sessions").otherwise(planned["reason"])
    return F.struct(path.alias("path"), reason.alias("reason"))
