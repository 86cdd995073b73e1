"""Compiling turns of sessions into typed facts, with proof that every unit of every turn was read.

``turns``: session_id, date (of the session), turn, role, text.  A turn is a
row and is compiled where it stands: its units (lines, list items, table rows,
sentences) each give a fact that holds the whole unit, and further facts for
each further number, each counter that goes up, each person of a kind, and
each outright statement.  Sessions are never gathered, so their length does
not matter; what needs an order (the state of a counter) is a window over the
few facts that carry a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quantities as Q
from ..functions import statements as S
from ..functions.chunks import stripped
from ..functions.text import bound
from ..session import settled

#: Roles that are read; characters of a line that stays whole and of a unit.
ROLES, LINE, UNIT = ("user", "assistant", "tool"), 240, 1200
LISTED, NUMBERED, RULE = r"^(?:[-*+] |\|)", r"^\d+[.)]\s+", r"^[#*_\-| :]+$"
#: Kinds of a unit and how it is meant, by the first pattern that it has.
KINDS = (
    ("list_item", r"^(?:\||[-*+] |\d+[.)]\s+)"),
    ("preference", r"(?i)\b(prefer|favorite|favourite|love|like|dislike|hate|avoid)\b"),
    ("plan", r"(?i)\b(plan|planning|going to|want to|would like to)\b"),
    ("state", r"(?i)\b(now|currently|used to|no longer|changed|updated|increased|decreased|raised|reduced|cut back|limit|switched|moved from|went from|previously|formerly)\b"),
)
MEANT = (("hypothetical", r"(?i)\b(if|could|would|might|hypothetical)\b"), ("negated", r"(?i)\b(no longer|did not|didn't|do not|don't|never)\b"))
GROWS = (
    r"(?i)\bI\s+(?:(?:just|recently)\s+)?(?:started|added|bought|acquired|adopted|hired|opened|created)\s+(?:a|an|one)\s+(?:new\s+)?"
    r"([A-Za-z]+(?:\s+[A-Za-z]+){0,2}?)(?=\s+(?:at|because|for|in|on|with)\b|[.!?]|$)"
)
#: People of a kind, by title, by "is my", by "my ...".
PERSON = r"[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+)"
KIND = "doctor|physician|therapist|counselor|lawyer|attorney|professor"
TITLED = rf"\b(Dr|Doctor|Prof|Professor)\.?\s+({PERSON}{{0,2}})\b"
IS_MY = rf"\b({PERSON}{{1,2}})\s+(?:is|was)\s+my\s+({KIND})\b"
MY = rf"\bmy\s+({KIND}),?\s+({PERSON}{{1,2}})\b"
#: Fixed value: what a unit has that one of the three patterns finds.
TELLS = rf"\b(?:Dr|Doctor|Prof|Professor|{KIND})\b"
#: Kinds of facts by kinds of claims.
OF_CLAIM = {"action": "event", "fact": "attribute", "goal": "plan", "plan": "plan", "preference": "preference", "state": "state", "suggestion": "recommendation"}
MONTHS = "january february march april may june july august september october november december".split()
SURE, SURE_GROWTH, SURE_MEMBER = 0.8, 0.88, 0.9

FACT = (
    "struct<id:string,excerpt:string,subject:string,predicate:string,object:string,kind:string,mode:string,event_date:date,"
    "quantity:struct<value:double,unit:string,role:string>,qualifiers:map<string,string>,supersession_key:string,confidence:double>"
)


def units(text: Column) -> Column:
    """Lines, long ones by sentences, none longer than ``UNIT``; not one twice, none of rules and bars alone."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\R|[\x1c-\x1e]"), stripped), lambda x: x != "")

    def cut(line: Column) -> Column:
        whole = line.rlike(LISTED) | line.rlike(NUMBERED) | (F.length(line) <= LINE)
        return F.when(whole, F.array(line)).otherwise(F.filter(F.transform(F.split(line, r"(?<=[.!?])\s+"), stripped), lambda x: x != ""))

    def chunked(unit: Column) -> Column:
        last = F.floor((F.length(unit) - 1) / F.lit(UNIT)).cast("int")
        return F.when(F.length(unit) <= UNIT, F.array(unit)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(unit, k * UNIT + 1, F.lit(UNIT))))

    parts = F.flatten(F.transform(F.flatten(F.transform(lines, cut)), chunked))
    plain = lambda u: F.lower(S.squeezed(u))
    kept = F.filter(parts, lambda u: ~u.rlike(RULE) & (plain(u) != ""))
    return bound(kept, lambda k: F.when(F.size(k) < 2, k).otherwise(S.first_of_each(k, plain)))


def resolved_date(text: Column, observed: Column) -> Column:
    """The day that a text names outright, or by today, yesterday and days or weeks ago; null for one that is none."""
    iso = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
    named = rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(20\d{{2}}))?\b"
    ago = r"\b(\d{1,6})\s+(days?|weeks?)\s+ago\b"
    low = F.lower(text)

    def day(year: Column, month: Column, of: Column) -> Column:
        return F.concat_ws("-", year, month, of).try_cast("date")

    part = lambda p, k: F.regexp_extract(text, p, k)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(named, 1))).cast("string")
    year = F.coalesce(F.nullif(part(named, 3), F.lit("")), F.year(observed).cast("string"))
    back = F.regexp_extract(low, ago, 1).try_cast("int") * F.when(F.regexp_extract(low, ago, 2).startswith("week"), 7).otherwise(1)
    return (
        F.when(observed.isNull(), F.lit(None).cast("date"))
        .when(text.rlike(iso), day(part(iso, 1), part(iso, 2), part(iso, 3)))
        .when(text.rlike(named), day(year, month, part(named, 2)))
        .when(low.rlike(r"\byesterday\b"), F.date_sub(observed, 1))
        .when(low.rlike(ago), F.date_sub(observed, back))
        .when(low.rlike(r"\btoday\b"), observed)
    )


def person_key(name: Column) -> Column:
    plain = F.regexp_replace(F.trim(name), r"(?i)^(?:dr|doctor|prof|professor)\.?\s+", "")
    return F.array_join(F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), 0), "_")


def members(unit: Column) -> Column:
    """(name, category, excerpt) of people whom a unit names as someone's doctor, lawyer and so on."""
    kinds = F.create_map(*(F.lit(x) for kv in Q.CATEGORIES.items() for x in kv))

    def all_of(pattern: str, name, category) -> Column:
        return F.transform(F.regexp_extract_all(unit, F.lit(pattern), 0), lambda m: F.struct(name(m).alias("name"), category(m).alias("category"), m.alias("excerpt")))

    titled = all_of(TITLED, lambda m: m, lambda m: F.when(F.lower(F.regexp_extract(m, TITLED, 1)).isin("dr", "doctor"), "doctor").otherwise("professor"))
    is_my = all_of(IS_MY, lambda m: F.regexp_extract(m, IS_MY, 1), lambda m: F.element_at(kinds, F.regexp_extract(m, IS_MY, 2)))
    my = all_of(MY, lambda m: F.regexp_extract(m, MY, 2), lambda m: F.element_at(kinds, F.regexp_extract(m, MY, 1)))
    named = F.filter(F.concat(titled, is_my, my), lambda m: person_key(m["name"]) != "")
    return F.when(unit.rlike(TELLS), bound(named, lambda a: S.first_of_each(a, lambda m: F.concat_ws("\x1f", person_key(m["name"]), m["category"])))).otherwise(F.array().cast("array<struct<name:string,category:string,excerpt:string>>"))


def _first(unit: Column, rules, other: Column) -> Column:
    out = F
    for name, pattern in rules:
        out = out.when(unit.rlike(pattern), name)
    return out.otherwise(other)


def _fact(id_, excerpt, subject, predicate, object_, kind, mode, event_date, quantity, qualifiers: dict, key, sure) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, (str, float)) or x is None else x
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), text(v).cast("string").alias("value")) for k, v in qualifiers.items()))
    said = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    parts = (id_, excerpt, subject, predicate, object_, kind, mode, event_date, quantity, said, key, sure)
    return F.struct(*(text(p).alias(n) for n, p in zip(("id", "excerpt", "subject", "predicate", "object", "kind", "mode", "event_date", "quantity", "qualifiers", "supersession_key", "confidence"), parts))).cast(FACT)


def _amount(q: Column) -> Column:
    return F.when(q.isNotNull(), F.struct(q["value"].alias("value"), q["unit"].alias("unit"), q["role"].alias("role")))


def _said_amount(value: Column) -> Column:
    """A number as text, whole ones without a point."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def _number_facts(id_: Column, unit: Column, subject: Column, kind: Column, mode: Column, numbers: Column) -> Column:
    """The fact that holds the unit and its first number, and one for each further number."""

    def fact(q: Column, k: Column) -> Column:
        counted = q["category"].isNotNull()
        key = F.when(q["snapshot"], F.concat(F.lit("user:current_quantity:"), q["category"]))
        first = k == 0
        own = F.when(first & key.isNotNull(), "state").when(first & (kind == "other") & q.isNotNull(), "quantity").when(~first & (kind == "other"), "quantity").otherwise(kind)
        qualifiers = {
            "atomic_origin": "deterministic_lossless", "normalized_quantity": F.concat(_said_amount(q["value"]), F.lit(" "), F.when(first & ~counted, q["unit"]).otherwise(q["unit"])), "quantity_index": F.when(~first, k.cast("string")),
            "quantity_context": q["context"], "closed_world_category": F.when(counted, "true"), "entity_category": q["category"], "quantity_role": F.when(counted, q["role"]), "counter_snapshot": F.when(q["snapshot"], "true"),
            "state_signal": F.when(own == "state", "true"),
        }
        name = F.when(first, id_).otherwise(F.concat(id_, F.lit("-q"), k.cast("string")))
        predicate = F.when(first, "stated").otherwise(F.concat(F.lit("stated_quantity_"), k.cast("string")))
        return _fact(name, unit, subject, predicate, unit, own, mode, None, _amount(q), qualifiers, key, SURE)

    nothing = F.array(F.lit(None).cast(Q.QUANTITY))
    return F.transform(F.when(F.size(numbers) > 0, numbers).otherwise(nothing), lambda q, k: fact(q, k))


def _growth_fact(id_: Column, unit: Column) -> Column:
    def fact(thing: Column) -> Column:
        one = F.struct(F.lit(1.0).alias("value"), thing.alias("unit"), F.lit("counter_increment").alias("role"))
        qualifiers = {"atomic_origin": "deterministic_semantic", "counter_operation": "increment", "counter_key": F.concat(F.lit("user:current_quantity:"), thing), "entity_category": thing}
        return _fact(F.concat(id_, F.lit("-delta")), F.regexp_extract(unit, GROWS, 0), "user", "counter_delta", thing, "event", "asserted", None, one, qualifiers, None, SURE_GROWTH)

    words = F.regexp_extract_all(F.regexp_extract(unit, GROWS, 1), F.lit("[A-Za-z]+"), 0)
    return F.when(unit.rlike(GROWS), F.array(bound(canonical(F.element_at(words, -1)), fact))).otherwise(F.array().cast(f"array<{FACT}>"))


def canonical(word: Column) -> Column:
    """As ``quantities.canonical``."""

    def of(low: Column) -> Column:
        out = F
        for ending in Q.ENDINGS:
            fits = low.endswith(ending) & (F.length(low) - len(ending) > 3)
            if ending == "s":
                fits = fits & ~low.rlike(f"({'|'.join(Q.KEEPS_S)})$")
            cut = F.substring(low, F.lit(1), F.length(low) - len(ending))
            out = out.when(fits, F.concat(cut, F.lit("y")) if ending == "ies" else cut)
        return out.otherwise(low)

    return bound(F.lower(word), of)


def _member_facts(id_: Column, unit: Column) -> Column:
    aliases = {c: ":".join(sorted(w for w, x in Q.CATEGORIES.items() if x == c)) for c in set(Q.CATEGORIES.values())}
    named = F.create_map(*(F.lit(x) for kv in sorted(aliases.items()) for x in kv))

    def fact(m: Column, k: Column) -> Column:
        qualifiers = {
            "atomic_origin": "deterministic_semantic", "canonical_entity_key": person_key(m["name"]), "entity_category": m["category"], "category_aliases": F.element_at(named, m["category"]), "closed_world_category": "false",
        }
        return _fact(F.concat(id_, F.lit("-membership-"), k.cast("string")), m["excerpt"], "user", "category_member", m["name"], "relationship", "asserted", None, None, qualifiers, None, SURE_MEMBER)

    return F.transform(members(unit), lambda m, k: fact(m, k))


def _claim_facts(id_: Column, claims: Column, date: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in OF_CLAIM.items() for x in kv))

    def fact(c: Column, k: Column) -> Column:
        qualifiers = {"atomic_origin": "deterministic_semantic", **{n: c[m] for n, m in (("family", "family"), ("polarity", "polarity"), ("stored_object", "stored_object"), ("event_time_expression", "time_expression"))}}
        return _fact(F.concat(id_, F.lit("-s"), k.cast("string")), c["excerpt"], c["subject"], c["predicate"], c["object"], F.element_at(kinds, c["kind"]), c["modality"], resolved_date(c["excerpt"], date), None, qualifiers, c["supersession_key"], c["confidence"])

    return F.transform(claims, lambda c, k: fact(c, k))


def compiled(turns: DataFrame, carried: tuple[str, ...] = (), dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """The facts (session_id, date, turn, unit, speaker, and the fields of a fact) and the coverage (session_id, turn, unit, unit_sha256, status, fact_ids).

    A statement's number is its object's first one.  Coverage names, for each
    unit, its own facts and the turn's statements that hold or are held by it.
    ``carried``: columns of a turn that its facts have, too; ``dealt`` says that
    the turns lie in as many tasks as they should, and stay where they are.
    """
    rows = turns.where(F.col("role").isin(*ROLES)).select("session_id", F.col("date").cast("date").alias("date"), "turn", F.col("role").alias("speaker"), "text", *carried)
    if not dealt:  # a turn is few bytes and much work: splits of a file by bytes leave most cores idle
        rows = rows.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "session_id", "turn")
    rows = rows.withColumn("claims", S.stated_claims(F.col("text"), F.col("speaker")))
    rows = rows.withColumn("at", F.concat_ws("-", F.col("session_id").cast("string"), F.concat(F.lit("t"), F.col("turn").cast("string"))))
    rows = rows.select("session_id", "date", "turn", "speaker", "at", *carried, _claim_facts(F.col("at"), F.col("claims"), F.col("date")).alias("stated"), units(F.col("text")).alias("units"))
    # outer, then without the empty ones: an inner one asks first whether the array has anything, and so works it out three times
    base = rows.select("session_id", "date", "turn", "speaker", "at", *carried, "stated", F.posexplode_outer("units").alias("unit", "said")).where("unit is not null")
    unit, user = F.col("said"), F.col("speaker") == "user"
    base = base.withColumn("id", F.concat(F.col("at"), F.lit("-u"), F.col("unit").cast("string"))).withColumns({"numbers": Q.quantities_of(unit), "sort": _first(unit, KINDS, F.lit("other")), "meant": _first(unit, MEANT, F.lit("asserted"))})
    none = F.array().cast(f"array<{FACT}>")
    more = F.when(user, F.concat(_growth_fact(F.col("id"), unit), _member_facts(F.col("id"), unit))).otherwise(none)
    numbered = _number_facts(F.col("id"), unit, F.col("speaker"), F.col("sort"), F.col("meant"), F.col("numbers"))
    found = base.select("session_id", "date", "turn", "speaker", *carried, "unit", "said", "stated", F.concat(numbered, more).alias("facts"))
    near = F.filter("stated", lambda f: F.contains(F.col("said"), f["excerpt"]) | F.contains(f["excerpt"], F.col("said")))
    ids = F.transform(F.concat("facts", near), lambda f: f["id"])
    coverage = found.select("session_id", "turn", "unit", F.sha2(F.col("said").cast("binary"), 256).alias("unit_sha256"), F.when(F.size(ids) > 0, "facts_extracted").otherwise("processed_no_fact").alias("status"), ids.alias("fact_ids"))
    keys = ("session_id", "date", "turn", "speaker", *carried)
    of_units = found.select(*keys, "unit", F.inline_outer("facts")).where("id is not null")
    of_claims = rows.select(*keys, F.lit(None).cast("int").alias("unit"), F.inline_outer("stated")).where("id is not null")
    first = F.get(Q.quantities_of(F.col("object")), F.lit(0))
    of_claims = of_claims.withColumn("quantity", _amount(first))
    return of_units.unionByName(of_claims), coverage


def counters(facts: DataFrame, *owner: str) -> DataFrame:
    """(owner, category, held, added, current): the last count that was declared, and what went up since.

    Facts of one owner and category alone are ordered, by date, session, turn and unit.
    """
    key = F.coalesce("supersession_key", F.col("qualifiers")["counter_key"])
    c = facts.select(*owner, "date", "session_id", "turn", "unit", F.regexp_extract(key, "^user:current_quantity:(.*)$", 1).alias("category"), F.col("quantity")["value"].alias("value"), F.col("qualifiers")["counter_snapshot"].isNotNull().alias("is_count"), (F.col("predicate") == "counter_delta").alias("is_step"))
    c = settled(c.where("is_count or is_step"))  # read twice below, compiled once
    late = F.struct("date", F.col("session_id"), "turn", "unit")
    last = c.where("is_count").groupBy(*owner, "category").agg(F.max_by("value", late).alias("held"), F.max(late).alias("at"))
    joined = c.where("is_step").select(*owner, "category", "value", late.alias("step")).join(last, [*owner, "category"], "full")
    out = joined.groupBy(*owner, "category").agg(F.max("held").alias("held"), F.sum(F.when(F.col("at").isNull() | (F.col("step") > F.col("at")), F.col("value"))).alias("added"))
    return out.select(*owner, "category", "held", F.coalesce("added", F.lit(0.0)).alias("added"), (F.coalesce("held", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))).alias("current"))
