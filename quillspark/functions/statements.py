"""Column functions that read what speakers state outright: typed claims with their exact words.

Everything is a Spark expression over one turn's text.  A user's turn is cut
into clauses; each family of patterns gives at most one claim of a clause.
Nothing is inferred: the excerpt of a claim stands in the text, white space
taken as one space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunks import claim_units, stripped
from .text import bound

#: The patterns of each family, in the order in which a clause is read.
END = r"(?:[.!?]|$)"
ACTIVITY = rf"(?i)\bi (?:(?:am|'m) currently|currently|(?:am|'m) now)\s+(reading|devouring|using|working on|obsessed with|keeping|storing|watching|driving|taking|wearing)\s+(.+?){END}"
USE = rf"(?i)\bi currently use\s+(.+?){END}"
QUANTITY = (
    rf"(?i)\bi (?:(?:am|'m) now at|now (?:have|own|lead)|currently (?:have|own|lead))\s+(.+?){END}"
    rf"|\bi (?:have|own|lead)\s+(.+?)\s+(?:right )?now{END}"
)
STORED = rf"(?i)\bi (?:(?:currently|now) )?(?:keep|store)\s+(.+?)\s+(?:in|on|at)\s+(.+?){END}"
FAVORITE = rf"(?i)\bmy favou?rite\s+(.+?)\s+is\s+(.+?){END}"
LIKES = rf"(?i)\bi (?:really )?(?:prefer|like|love|enjoy)\s+(.+?){END}"
RATHER = rf"(?i)\bi(?:'d| would) rather\s+(.+?)(?:\s+than\s+.+?)?{END}"
DISLIKES = rf"(?i)\bi (?:(?:do not|don't) like|no longer like|dislike|hate|avoid|can't stand|cannot stand)\s+(.+?){END}"
HABIT = rf"(?i)\bi (?:usually|typically|normally) (?:choose|pick|reach for|go with)\s+(.+?){END}"
FIRST_CHOICE = rf"(?i)\b(.+?) is my (?:usual |typical )?first choice{END}"
NO_HABIT = rf"(?i)\bi (?:do not|don't|no longer) reach for\s+(.+?)(?:\s+anymore)?{END}"
#: Predicate, kind, whether a later claim takes its place, family, pattern.
STATED = (
    ("lives_in", "state", True, "location", rf"(?i)\bi (?:now )?(?:live in|moved to)\s+(.+?){END}"),
    ("lives_in", "state", True, "location", rf"(?i)\bi (?:am|'m) based in\s+(.+?){END}"),
    ("works_at", "state", True, "work", rf"(?i)\bi (?:now )?work at\s+(.+?){END}"),
    ("name", "fact", True, "identity", rf"(?i)\bmy name is\s+(.+?){END}"),
    ("timezone", "state", True, "locale", rf"(?i)\bmy time ?zone is\s+(.+?){END}"),
    ("role", "state", True, "work", rf"(?i)\bi (?:work as|am employed as)\s+(?:an?\s+)?(.+?){END}"),
    ("role", "state", True, "work", rf"(?i)\bmy (?:role|job title) is\s+(.+?){END}"),
    ("speaks", "fact", False, "language", rf"(?i)\bi speak\s+(.+?){END}"),
    ("goal", "goal", False, "goal", rf"(?i)\bmy goal is(?: to)?\s+(.+?){END}"),
    ("decided", "action", False, "decision", rf"(?i)\bi (?:decided|have decided) to\s+(.+?){END}"),
    ("stated_fact", "fact", False, "explicit_memory", rf"(?i)\bremember that\s+(.+?){END}"),
    ("plans", "plan", False, "", rf"(?i)\bi (?:plan to|am going to|want to|would like to)\s+(.+?){END}"),
)
ACTION = rf"(?i)\bi (?:just |recently |already |finally )?(bought|made|visited|completed|finished|started|stopped|attended|used|tried)\s+(.+?){END}"
DENIED = (
    ("lives_in", rf"(?i)\bi (?:no longer|do not|don't) live in\s+(.+?){END}"),
    ("works_at", rf"(?i)\bi (?:no longer|do not|don't) work at\s+(.+?){END}"),
)
SUGGESTED = rf"(?i)(?:\byou (?:could|should|might)|\btry|\bconsider|\bi recommend)\s+(.+?){END}"
UNSURE = r"(?i)\b(if|would|could|might)\b"
WHEN = r"(?i)\s+(today|yesterday|last week|\d+\s+(?:days?|weeks?)\s+ago|on\s+\d{4}-\d{2}-\d{2})$"

CLAIM = "struct<subject:string,predicate:string,object:string,kind:string,excerpt:string,modality:string,supersession_key:string,supersedes:boolean,confidence:double,family:string,polarity:string,stored_object:string,time_expression:string>"


def topic_key(text: Column) -> Column:
    """A topic without case, possessives, marks and a leading article, words joined by an underscore."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]s\\b", ""), "[^a-z0-9]+", " ")
    return F.regexp_replace(F.regexp_replace(F.trim(plain), "^(?:a|an|the)\\s+", ""), " +", "_")


def plain_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_.:-]+", "_"), "^_+|_+$", "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s  - 　]+", " "), "^ | $", "")


def first_of_each(items: Column, key) -> Column:
    """``items`` without those whose ``key`` an earlier one has; by sorting, not by pairs."""
    keyed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))

    def firsts(s: Column) -> Column:
        shifted = F.concat(F.array(F.lit(None).cast("struct<k:string,i:int>")), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
        marked = F.zip_with(s, shifted, lambda a, b: F.struct(a["i"].alias("i"), (b.isNull() | ~a["k"].eqNullSafe(b["k"])).alias("new")))
        return F.sort_array(F.transform(F.filter(marked, lambda m: m["new"]), lambda m: m["i"]))

    places = bound(F.sort_array(keyed), firsts)
    return F.when(F.size(items) > 0, F.transform(places, lambda i: F.get(items, i))).otherwise(items)


def _claim(predicate, object_: Column, kind: str, excerpt: Column, key=None, supersedes: bool = False, confidence: float = 0.9, family: str = "", polarity: str = "", modality: str = "asserted", stored=None, when=None) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit("user").alias("subject"), text(predicate).alias("predicate"), object_.alias("object"), F.lit(kind).alias("kind"), excerpt.alias("excerpt"), F.lit(modality).alias("modality"),
        (none if key is None else text(key)).alias("supersession_key"), F.lit(supersedes).alias("supersedes"), F.lit(confidence).alias("confidence"),
        F.lit(family or None).cast("string").alias("family"), F.lit(polarity or None).cast("string").alias("polarity"),
        (none if stored is None else stored).alias("stored_object"), (none if when is None else when).alias("time_expression"),
    ).cast(CLAIM)


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.trim(F.regexp_extract(text, pattern, k))


def _found(text: Column, pattern: str, claim: Column, unless: Column | None = None) -> Column:
    hit = text.rlike(pattern)
    return F.when(hit if unless is None else hit & ~unless, claim)


def _prefers(text: Column, pattern: str, value: Column, positive: bool = True, topic: Column | None = None, family: str = "preference", confidence: float = 0.9, unless: Column | None = None) -> Column:
    key = F.concat(F.lit("user:preference:"), topic_key(value) if topic is None else topic)
    claim = _claim("prefers" if positive else "avoids", value, "preference", F.regexp_extract(text, pattern, 0), key, True, confidence, family, "positive" if positive else "negative")
    return _found(text, pattern, claim, unless)


def _without_time(value: Column) -> tuple[Column, Column]:
    """A value without a time at its end, and that time."""
    cut = F.regexp_replace(F.regexp_replace(value, WHEN, ""), "^[ ,]+|[ ,]+$", "")
    said = F.nullif(F.regexp_extract(value, WHEN, 1), F.lit(""))
    return F.when(said.isNotNull() & (cut != ""), cut).otherwise(value), said


def clause_claims(clause: Column) -> Column:
    """The claims of one clause of a user, by family."""
    whole = lambda p: F.regexp_extract(clause, p, 0)
    verb = F.regexp_replace(F.lower(_group(clause, ACTIVITY, 1)), " ", "_")
    verb = F.when(verb == "devouring", "reading").otherwise(verb)
    amount = F.coalesce(F.nullif(_group(clause, QUANTITY, 1), F.lit("")), _group(clause, QUANTITY, 2))
    thing = _group(clause, STORED, 1)
    favorite = F.concat(F.lit("favorite:"), plain_key(_group(clause, FAVORITE, 1)))
    liked = F.trim(F.regexp_replace(_group(clause, LIKES, 1), r"(?i)\s+over\s+.*$", ""))
    found = [
        _found(clause, ACTIVITY, _claim(F.concat(F.lit("currently_"), verb), _group(clause, ACTIVITY, 2), "state", whole(ACTIVITY), F.concat(F.lit("user:current_activity:"), verb), True, 0.92, "current_activity")),
        _found(clause, USE, _claim("currently_uses", _group(clause, USE, 1), "state", whole(USE), "user:currently_uses", True, 0.92, "current_possession_or_use")),
        _found(clause, QUANTITY, _claim("current_quantity", amount, "state", whole(QUANTITY), F.concat(F.lit("user:current_quantity:"), topic_key(amount)), True, 0.9, "current_quantity")),
        _found(clause, STORED, _claim("currently_stored_at", _group(clause, STORED, 2), "state", whole(STORED), F.concat(F.lit("user:stored_location:"), topic_key(thing)), True, 0.92, "stored_location", stored=thing)),
        _prefers(clause, FAVORITE, _group(clause, FAVORITE, 2), topic=favorite, family="favorite"),
        _prefers(clause, LIKES, liked),
        _prefers(clause, RATHER, _group(clause, RATHER, 1)),
        _prefers(clause, DISLIKES, _group(clause, DISLIKES, 1), False),
        _prefers(clause, HABIT, _group(clause, HABIT, 1), family="habitual_choice", confidence=0.84),
        _prefers(clause, FIRST_CHOICE, _group(clause, FIRST_CHOICE, 1), family="first_choice", confidence=0.84, unless=F.regexp_extract(clause, FIRST_CHOICE, 1).rlike(UNSURE)),
        _prefers(clause, NO_HABIT, _group(clause, NO_HABIT, 1), False, family="habitual_choice", confidence=0.84),
    ]
    for predicate, kind, later, family, pattern in STATED:
        value, said = _without_time(_group(clause, pattern, 1))
        found.append(_found(clause, pattern, _claim(predicate, value, kind, whole(pattern), f"user:{predicate}" if later else None, later, 0.9, family, when=said)))
    done, said = _without_time(_group(clause, ACTION, 2))
    found.append(_found(clause, ACTION, _claim("completed_action", F.concat(_group(clause, ACTION, 1), F.lit(" "), done), "action", whole(ACTION), when=said)))
    for predicate, pattern in DENIED:
        found.append(_found(clause, pattern, _claim(predicate, _group(clause, pattern, 1), "state", whole(pattern), f"user:{predicate}", True, 0.95, modality="negated")))
    return F.array_compact(F.array(*found))


def stated_claims(text: Column, speaker: Column) -> Column:
    """The claims of a turn; an assistant's first suggestion, nothing of other speakers."""
    role = F.lower(F.trim(speaker))

    def of_user(said: Column) -> Column:
        clauses = F.flatten(F.transform(claim_units(said), clause_claims))
        key = lambda c: F.concat_ws("\x1f", c["predicate"], plain_key(c["object"]), c["modality"], F.lower(c["excerpt"]))
        return bound(clauses, lambda c: F.when(F.size(c) < 2, c).otherwise(first_of_each(c, key)))

    def of_assistant(said: Column) -> Column:
        return F.array_compact(F.array(_found(said, SUGGESTED, _claim("suggested_option", _group(said, SUGGESTED, 1), "suggestion", F.regexp_extract(said, SUGGESTED, 0)))))

    none = F.array().cast(f"array<{CLAIM}>")
    return F.when(role == "user", bound(squeezed(text), of_user)).when(role == "assistant", bound(squeezed(text), of_assistant)).otherwise(none)
