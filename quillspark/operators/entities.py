"""Normal forms of proposed memories: entities, events, relations and table cells that their sources bear out.

Proposals are flat tables, one row a mention, event, participant, amount,
relation or cell, each with the session, its place among its likes (``nth``)
and a citation (turn, excerpt).  Nothing is believed: a row whose excerpt does
not stand in its turn, whose words do not stand in its excerpt, or that refers
to what is not there is rejected with its first reason.  Mentions and events
that name each other become one by connected components.  All results are
linked tables; keys come from contents, so the order of rows does not matter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statements import squeezed
from ..session import settled
from .graph import components

#: Roles of turns, references that need no mention, words that begin a name that is none, and what no done or asserted thing says.
ROLES = ("user", "assistant", "tool")
GENERIC = ("a", "an", "my", "our", "the", "their", "this", "your")
NOT_DONE = r"(?i)\b(should|could|might|plans?|planning|wants?|would|if|recommend(?:ed|s)?|suggest(?:ed|s)?|propos(?:e|ed|es)|did not|didn't|do not|don't|never|not(?!\s+only\b))\b"
NOT_ASSERTED = r"(?i)\b(might|would|if|did not|didn't|do not|don't|never|not(?!\s+only\b))\b"
#: A cell of the line below a table's heads; characters of the longest table that is cited.
SEPARATOR, LONGEST_TABLE = re.compile(r":?-{3,}:?"), 1200
CELL = "struct<cell_id:string,excerpt:string,table_id:string,row_label:string,column_label:string,value_text:string,row_index:int,column_index:int>"


def plain(text: Column) -> Column:
    return F.lower(squeezed(text))


def key(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(plain(text), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def fingerprint(prefix: str, *parts: Column) -> Column:
    said = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))
    return F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(said, 256), 1, 20))


def table_cells(text: str | None) -> list[dict]:
    """The cells of Markdown tables, but for the first column, which labels rows."""

    def split(line: str) -> list[str]:
        return [c.strip() for c in line.strip().strip("|").split("|")]

    lines, out, at, number = (text or "").splitlines(), [], 0, 0
    while at + 2 < len(lines):
        heads, below, end = split(lines[at]), split(lines[at + 1]), at + 2
        if len(heads) > 1 and len(heads) == len(below) and all(map(SEPARATOR.fullmatch, below)):
            while end < len(lines) and "|" in lines[end]:
                end += 1
        if end == at + 2:
            at += 1
            continue
        excerpt = "\n".join(lines[at:end])
        if len(excerpt) <= LONGEST_TABLE:
            for r, line in enumerate(lines[at + 2 : end], 1):
                values = split(line)
                if len(values) == len(heads) and values[0]:
                    for c in range(1, len(heads)):
                        if heads[c] and values[c]:
                            out.append({"cell_id": f"{number}-{r}-{c}", "excerpt": excerpt, "table_id": str(number), "row_label": values[0], "column_label": heads[c], "value_text": values[c], "row_index": r, "column_index": c})
            number += 1
        at = end
    return out


def proposed_cells(turns: DataFrame) -> DataFrame:
    """Cells that the tables of ``turns`` (session_id, turn, role, text) propose."""

    @F.pandas_udf(f"array<{CELL}>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(table_cells)

    rows = turns.where(F.contains("text", F.lit("|"))).select("session_id", "turn", F.explode(read("text")).alias("c"))
    of_turn = lambda c: F.concat_ws("-", F.col("turn").cast("string"), F.col(f"c.{c}"))
    return rows.select("session_id", of_turn("cell_id").alias("cell_id"), F.monotonically_increasing_id().alias("nth"), "turn", "c.excerpt", of_turn("table_id").alias("table_id"), "c.row_label", "c.column_label", "c.value_text", "c.row_index", "c.column_index")


def _once(rows: DataFrame, id_: str, reason: str) -> DataFrame:
    """With ``why``: the given reason on all but the first row of an id."""
    nth = F.row_number().over(Window.partitionBy("session_id", id_).orderBy("nth"))
    return rows.withColumn("why", F.when(nth > 1, reason))


def _cited(rows: DataFrame, turns: DataFrame, roles) -> DataFrame:
    """With begins and ends of the excerpt in its turn, and ``why`` where the turn does not bear it out."""
    t = turns.select("session_id", "turn", F.col("role").alias("said_by"), F.coalesce("text", F.lit("")).alias("said"), F.lit(True).alias("there"))
    got = rows.join(t, ["session_id", "turn"], "left")
    at = F.instr("said", F.col("excerpt"))
    why = F.when(F.col("there").isNull(), "citation_turn_out_of_range").when(~F.coalesce(F.col("said_by").isin(*ROLES), F.lit(False)), "citation_role_invalid").when(~F.col("said_by").isin(*roles), "citation_role_out_of_scope").when(at == 0, "citation_excerpt_not_exact")
    return got.withColumn("why", F.coalesce("why", why)).withColumn("begins", at - 1).withColumn("ends", at - 1 + F.length("excerpt")).drop("said", "there")


def _also(rows: DataFrame, wrong: Column, reason: str) -> DataFrame:
    return rows.withColumn("why", F.coalesce("why", F.when(F.coalesce(wrong, F.lit(False)), reason)))


def _holds(part: Column) -> Column:
    """Whether words, and some, stand in the excerpt."""
    return (plain(part) != "") & F.contains(plain(F.col("excerpt")), plain(part))


def _together(rows: DataFrame, id_: str, other: str) -> DataFrame:
    """With ``root``: one value for the rows of a session that name each other by ``other``."""
    node = lambda c: F.concat_ws("\x1f", F.col("session_id").cast("string"), c)
    edges = rows.where(F.col(other).isNotNull()).select(node(id_).alias("src"), node(other).alias("dst"))
    found = components(edges).select(F.col("node").alias("own"), F.col("component").alias("found"))
    return rows.withColumn("own", node(id_)).join(found, "own", "left").withColumn("root", F.coalesce("found", "own")).drop("own", "found")


def entities(mentions: DataFrame, turns: DataFrame, roles=ROLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, (session_id, ref, entity_key) of the mentions, and rejections.

    ``mentions``: session_id, mention_id, nth, surface, kind, categories,
    alias_of, turn, excerpt.  A name with a capital and no article names the
    entity, else the longest.
    """
    m = _cited(mentions.withColumn("why", F.lit(None).cast("string")), turns, roles)
    m = _also(m, ~_holds(F.col("surface")), "entity_surface_not_in_citation")
    taken = F.min(F.when(F.col("why").isNull(), F.col("nth"))).over(Window.partitionBy("session_id", "mention_id"))  # the first that holds has the id
    m = settled(m.withColumn("why", F.when(F.col("nth") > taken, "duplicate_mention_id").otherwise(F.col("why"))))
    good = m.where("why is null")
    other = good.select("session_id", F.col("mention_id").alias("alias_of"), F.col("kind").alias("other_kind"))
    named = settled(good.join(other, ["session_id", "alias_of"], "left"))
    amiss = F.when(F.col("alias_of").isNotNull() & F.col("other_kind").isNull(), "alias_reference_missing").when(F.col("other_kind") != F.col("kind"), "alias_kind_mismatch")
    joined = _together(named.withColumn("alias_of", F.when(F.col("other_kind") == F.col("kind"), F.col("alias_of"))), "mention_id", "alias_of")
    surface = F.trim("surface")
    proper = surface.rlike(r"\p{Lu}") & ~F.split(plain(surface), " ")[0].isin(*GENERIC)
    best = F.max_by(surface, F.struct(proper.cast("int"), F.length(surface), plain(surface), surface))
    cats = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(F.coalesce("categories", F.array().cast("array<string>")), key)))))
    e = joined.groupBy("session_id", "root").agg(best.alias("canonical_name"), F.min("kind").alias("kind"), F.array_sort(F.collect_set(surface)).alias("aliases"), cats.alias("categories"), F.array_sort(F.collect_list("mention_id")).alias("mentions"))
    e = settled(e.select("session_id", F.concat_ws(":", F.lit("entity"), "kind", key(F.col("canonical_name"))).alias("entity_key"), "canonical_name", "kind", "aliases", "categories", "mentions"))
    refs = e.select("session_id", F.explode("mentions").alias("ref"), "entity_key")
    bad = m.where("why is not null").select("session_id", "why").unionByName(named.select("session_id", amiss.alias("why")).where("why is not null"))
    return e, refs, bad


def _resolved(rows: DataFrame, refs: DataFrame, ref: str, name: str) -> DataFrame:
    known = refs.select("session_id", F.col("ref").alias(ref), F.col("entity_key").alias(name))
    got = rows.join(known, ["session_id", ref], "left")
    return got.withColumn(name, F.when(F.col(ref).isin(*ROLES), F.col(ref)).otherwise(F.col(name)))


def events(proposed: DataFrame, participants: DataFrame, amounts: DataFrame, refs: DataFrame, turns: DataFrame, roles=ROLES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Events, their participants, their amounts, and rejections.

    ``proposed``: session_id, event_id, nth, type, status, event_date, same_as,
    turn, excerpt, confidence; ``participants``: session_id, event_id, nth, role,
    entity_ref, literal; ``amounts``: session_id, event_id, value, unit, role.
    """
    e = settled(_once(proposed, "event_id", "duplicate_event_id"))
    first = e.where("why is null").drop("why")
    other = first.select("session_id", F.col("event_id").alias("same_as"), F.lit(True).alias("known"))
    first = first.join(other, ["session_id", "same_as"], "left")
    lost = F.col("same_as").isNotNull() & F.col("known").isNull()
    missing = first.where(lost).select("session_id", F.lit("event_identity_reference_missing").alias("why"))
    same = _together(first.where(~lost).drop("known"), "event_id", "same_as")
    parts = F.array_sort(F.collect_list(F.concat_ws("\x1f", key(F.col("type")), F.col("turn").cast("string"), plain(F.col("excerpt")))))
    identity = same.groupBy("session_id", "root").agg(parts.alias("parts")).select("root", fingerprint("event-identity", F.col("session_id"), F.array_join("parts", "\x1e")).alias("event_identity_key"))
    good = _cited(same.join(identity, "root").withColumn("why", F.lit(None).cast("string")), turns, roles)
    good = _also(good, (F.col("status") == "completed") & F.col("excerpt").rlike(NOT_DONE), "completed_event_not_supported_by_modality")
    p = _resolved(participants, refs, "entity_ref", "entity_key").join(same.select("session_id", "event_id", "excerpt"), ["session_id", "event_id"])
    wrong = F.when(F.col("entity_ref").isNotNull() & F.col("entity_key").isNull(), "event_participant_reference_missing").when(F.col("literal").isNotNull() & ~_holds(F.col("literal")), "event_literal_not_in_citation")
    p = settled(p.select("session_id", "event_id", "nth", key(F.col("role")).alias("role"), "entity_key", "literal", wrong.alias("wrong")))
    amiss = p.where("wrong is not null").groupBy("session_id", "event_id").agg(F.min_by("wrong", "nth").alias("amiss"))
    good = good.join(amiss, ["session_id", "event_id"], "left").withColumn("why", F.coalesce("why", "amiss"))
    listed = p.groupBy("session_id", "event_id").agg(F.array_sort(F.collect_list(F.concat_ws("\x1f", "role", F.coalesce("entity_key", F.lit("")), F.coalesce("literal", F.lit(""))))).alias("who"))
    q = amounts.select("session_id", "event_id", F.col("value").cast("double").alias("value"), key(F.col("unit")).alias("unit"), key(F.col("role")).alias("role"))
    counted = q.groupBy("session_id", "event_id").agg(F.array_sort(F.collect_list(F.concat_ws("\x1f", F.col("value").cast("string"), "unit", "role"))).alias("much"))
    good = settled(good.join(listed, ["session_id", "event_id"], "left").join(counted, ["session_id", "event_id"], "left").withColumn("type", key(F.col("type"))))
    made = fingerprint("event", *(F.col(c) for c in ("session_id", "type", "status", "event_date", "turn", "begins", "ends")), F.array_join("who", "\x1e"), F.array_join("much", "\x1e"))
    out = good.where("why is null").select("session_id", "event_id", made.alias("event_key"), "event_identity_key", "type", "status", "event_date", "turn", "begins", "ends", "confidence")
    mine = out.select("session_id", "event_id", "event_key", "type", "status")
    bad = e.where("why is not null").select("session_id", "why").unionByName(missing).unionByName(good.where("why is not null").select("session_id", "why"))
    return out, p.join(mine, ["session_id", "event_id"]).drop("nth", "wrong"), q.join(mine, ["session_id", "event_id"]), bad


def relations(proposed: DataFrame, refs: DataFrame, turns: DataFrame, roles=ROLES) -> tuple[DataFrame, DataFrame]:
    """Relations and rejections.  ``proposed``: session_id, relation_id, nth, subject_ref, predicate, object_ref, object_text, mode, valid_from, scope, turn, excerpt, confidence."""
    r = _cited(_once(proposed, "relation_id", "duplicate_relation_id"), turns, roles)
    r = _also(r, (F.col("mode") == "asserted") & F.col("excerpt").rlike(NOT_ASSERTED), "asserted_relation_not_supported_by_modality")
    r = _resolved(_resolved(r, refs, "subject_ref", "subject_key"), refs, "object_ref", "object_key")
    r = _also(r, F.col("subject_key").isNull(), "relation_subject_reference_missing")
    r = _also(r, F.col("object_ref").isNotNull() & F.col("object_key").isNull(), "relation_object_reference_missing")
    r = settled(_also(r, F.col("object_text").isNotNull() & ~_holds(F.col("object_text")), "relation_literal_not_in_citation").withColumn("predicate", key(F.col("predicate"))))
    supersession = F.when(F.coalesce(F.col("scope"), F.lit("")) != "", F.concat(F.lit("supersession:"), "subject_key", F.lit(":"), key(F.col("scope"))))
    made = fingerprint("relation", *(F.col(c) for c in ("session_id", "subject_key", "predicate", "object_key", "object_text", "mode", "valid_from", "turn", "begins", "ends")), supersession)
    out = r.where("why is null").select("session_id", made.alias("relation_key"), "subject_key", "predicate", "object_key", "object_text", "mode", "valid_from", supersession.alias("supersession_key"), "turn", "begins", "ends", "confidence")
    return out, r.where("why is not null").select("session_id", "why")


def cells(proposed: DataFrame, turns: DataFrame, roles=ROLES) -> tuple[DataFrame, DataFrame]:
    """Table cells and rejections."""
    c = _cited(_once(proposed, "cell_id", "duplicate_table_cell_id"), turns, roles)
    c = settled(_also(c, ~(_holds(F.col("row_label")) & _holds(F.col("column_label")) & _holds(F.col("value_text"))), "table_value_not_in_citation"))
    table = fingerprint("table", F.col("session_id"), F.col("turn"), key(F.col("table_id")))
    made = fingerprint("cell", table, plain(F.col("row_label")), plain(F.col("column_label")), plain(F.col("value_text")), F.col("begins"))
    out = c.where("why is null").select("session_id", made.alias("cell_key"), table.alias("table_key"), F.trim("row_label").alias("row_label"), F.trim("column_label").alias("column_label"), F.trim("value_text").alias("value_text"), "row_index", "column_index", "turn")
    return out, c.where("why is not null").select("session_id", "why")


def normalized(turns: DataFrame, mentions: DataFrame, proposed_events: DataFrame, participants: DataFrame, amounts: DataFrame, proposed_relations: DataFrame, proposed: DataFrame, roles=ROLES) -> dict[str, DataFrame]:
    """All tables by name, with rejections (session_id, why, n) and coverage (session_id, turns, rejected, complete)."""
    e, refs, bad_e = entities(mentions, turns, roles)
    v, p, q, bad_v = events(proposed_events, participants, amounts, refs, turns, roles)
    r, bad_r = relations(proposed_relations, refs, turns, roles)
    c, bad_c = cells(proposed, turns, roles)
    bad = bad_e.unionByName(bad_v).unionByName(bad_r).unionByName(bad_c)
    rejected = bad.groupBy("session_id", "why").agg(F.count("*").alias("n"))
    every = turns.groupBy("session_id").agg(F.count_if(F.col("role").isin(*roles)).alias("turns"))
    coverage = every.join(rejected.groupBy("session_id").agg(F.sum("n").alias("rejected")), "session_id", "left").select("session_id", "turns", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.col("rejected").isNull().alias("complete"))
    return {"entities": e, "refs": refs, "events": v, "participants": p, "amounts": q, "relations": r, "cells": c, "rejected": rejected, "coverage": coverage}


def signatures(tables: dict[str, DataFrame]) -> DataFrame:
    """(session_id, signature): what a session says, in strings that compare whatever the order and the keys."""
    e = tables["entities"].withColumn("name", plain(F.col("canonical_name")))
    names = e.select("session_id", "entity_key", "name").dropDuplicates(["session_id", "entity_key"])

    def named(rows: DataFrame, column: str, into: str) -> DataFrame:
        got = rows.join(names.select("session_id", F.col("entity_key").alias(column), F.col("name").alias(into)), ["session_id", column], "left")
        return got.withColumn(into, F.coalesce(into, column))

    def said(rows: DataFrame, *parts) -> DataFrame:
        return rows.select("session_id", F.concat_ws("|", *(F.lit(p[1:]) if p.startswith("=") else F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)).alias("signature"))

    amount = lambda q: q.withColumn("value", F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string")))
    p = named(tables["participants"], "entity_key", "who").withColumn("who", F.coalesce("who", plain(F.col("literal"))))
    r = named(named(tables["relations"], "subject_key", "subject"), "object_key", "object").withColumn("object", F.coalesce("object", plain(F.col("object_text"))))
    c = tables["cells"].select("session_id", *(plain(F.col(x)).alias(x) for x in ("row_label", "column_label", "value_text")))
    parts = [
        said(e, "=entity", "name", "kind"), said(e.select("session_id", "name", F.explode("categories").alias("category")), "=category", "name", "category"), said(e.select("session_id", "name", F.explode(F.transform("aliases", plain)).alias("alias")), "=alias", "name", "alias"),
        said(tables["events"], "=event", "type", "status"), said(p, "=event_participant", "type", "status", "role", "who"), said(amount(tables["amounts"]), "=quantity", "=event", "type", "role", "value", "unit"),
        said(r, "=relation", "predicate", "subject", "object", "mode"), said(r.where("supersession_key is not null"), "=supersession", "predicate", "subject"), said(c, "=table", "row_label", "column_label", "value_text"),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()
