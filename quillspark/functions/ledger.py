"""Column functions that label claims: what a question asks for, how a claim is meant, what its numbers and events are; number words, polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no terms of a question or claim.
LEDGER_STOP_WORDS = (
    "about after again also been before could did does from have into many more much should that their them then there these they this those "
    "what when where which with would your you were was are the and for how who why get"
).split()
#: Operations by question type (a part of it) and question (first match wins).
PLANS = (
    ("duration", "temporal", r"\bhow long\b|\b(days?|weeks?|months?|years?)\b|\bwhen\b"),
    ("aggregate", None, r"\bhow (?:many|much|often)\b|\b(total|combined|sum)\b"),
    ("latest_state", "knowledge-update", r"\b(current|latest|now|still|changed|updated)\b"),
    ("preference", "preference", None),
)
#: How a user's claim is meant, what its numbers and its event are (first match wins).
MODES = (
    ("hypothetical", r"\b(if|might|maybe|would|could|hypothetically)\b"),
    ("planned", r"\b(plan(?:ning)?|intend|want to|going to|will|hope to)\b"),
    ("completed", r"\b(did|attended|completed|finished|bought|visited|went|got back|returned|started|made|used|tried|serviced|have been|i've been)\b"),
    ("current", r"\b(am|is|are|currently|now|still|remember|have)\b"),
)
NUMBER_ROLES = (
    ("cumulative_snapshot", r"\b(so far|in total|total of|altogether|already|now|to date|that's)\b"),
    ("delta", r"\b(another|additional|more|added|extra|increment)\b"),
    ("measurement", r"\b(ounces?|pounds?|kg|kilograms?|miles?|km|percent|%)\b"),
    ("delta", r"\b(attended|bought|sold|completed|visited|went|made|fixed|assembled|watched|ran|donated|added|received|created)\b"),
)
#: How many of these rules the older reading of numbers has, and what a number is that none names, then and now.
OLDER_ROLES, OLDER_NUMBER, BARE_NUMBER = 3, "cumulative_snapshot", "measurement"
EVENTS = (
    ("start", r"\b(started|began|left|departed|set out)\b"),
    ("end", r"\b(got back|returned|ended|finished|completed|arrived home)\b"),
    ("update", r"\b(now|currently|updated|changed|instead|remember)\b"),
)
SMALL_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
HAS_NUMBER = rf"(^|[^\w.])\d|\b({'|'.join([*SMALL_NUMBERS, 'twenty'])})\b"
#: Phrases that contradict each other.
POLARITY = (("must ", "must not"), ("will ", "will not"), ("should ", "should not"), ("is enabled", "is disabled"), ("allowed", "not allowed"), ("use retrieval first", "do not use retrieval first"))
#: What a claim's score gives for numbers, times, speakers and breadth, and what asks for them.
ASKS_NUMBER = r"\b(how many|how much|how long|percent|total|more|less|older|younger)\b"
ASKS_TIME = r"\b(when|before|after|latest|current|now|changed)\b"
ASKS_BREADTH = r"\b(how many|how much|how often|how long|total|combined|sum|times did|more|less|older|younger|before|after|changed|change|current|latest)\b"
SAYS_NUMBER, SAYS_TIME = r"\b\d[\d,./:%-]*\b", r"\b(today|yesterday|tomorrow|last|next|since|until|\d{4})\b"


def first_of(text: Column, rules, other: str) -> Column:
    """Name of the first pattern that ``text`` has."""
    out = F
    for name, pattern in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def terms(text: Column) -> Column:
    """Distinct words of three ASCII letters or digits and more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(LEDGER_STOP_WORDS)))


def bigrams(text: Column) -> Column:
    """Distinct pairs of words that follow each other once stop words are gone."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0), lambda w: ~w.isin(LEDGER_STOP_WORDS))
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, 1 << 20), lambda a, b: F.concat(a, F.lit(" "), b)))


def plan(question: Column, kind: Column) -> Column:
    """What a question asks for."""
    low, out = F.lower(question), F
    for name, part, pattern in PLANS:
        hit = F.lit(False) if part is None else F.contains(kind, F.lit(part))
        out = out.when(hit if pattern is None else hit | low.rlike(pattern), name)
    return out.otherwise("fact_lookup")


def assertion_mode(text: Column, speaker: Column) -> Column:
    return F.when(speaker == "assistant", "suggested").otherwise(first_of(F.lower(text), MODES, "unknown"))


def number_role(text: Column, older: bool = False) -> Column:
    """What a claim's number says; a bare number is no running total, but for the ``older`` reading."""
    low = F.lower(text)
    rules, bare = (NUMBER_ROLES[:OLDER_ROLES], OLDER_NUMBER) if older else (NUMBER_ROLES, BARE_NUMBER)
    return F.when(~low.rlike(HAS_NUMBER), "unknown").otherwise(first_of(low, rules, bare))


def event_role(text: Column) -> Column:
    return first_of(F.lower(text), EVENTS, "none")


def number_words(text: Column) -> Column:
    """Value of a run of number words; null with any other word, or none."""
    small = {w: i for i, w in enumerate(SMALL_NUMBERS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | {"dozen": 12}
    value = F.create_map(*(F.lit(x) for kv in small.items() for x in kv))
    words = F.filter(F.split(F.lower(text), " +"), lambda w: (w != "") & (w != "and"))
    state = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(True).alias("known"))

    def add(s, w):
        n, now = F.element_at(value, w), s["now"]
        more = F.when(w == "hundred", F.greatest(F.lit(1).cast("long"), now) * 100).when(w == "thousand", F.lit(0).cast("long")).otherwise(now + F.coalesce(n, F.lit(0)))
        total = s["total"] + F.when(w == "thousand", F.greatest(F.lit(1).cast("long"), now) * 1000).otherwise(0)
        return F.struct(total.alias("total"), more.alias("now"), (s["known"] & (n.isNotNull() | w.isin("hundred", "thousand"))).alias("known"))

    got = F.aggregate(words, state, add, lambda s: F.when(s["known"], (s["total"] + s["now"]).cast("double")))
    return F.when(F.size(words) > 0, got)


def contradicts(left: Column, right: Column) -> Column:
    """Whether two lower-cased texts have opposite phrases and share two words of four letters or digits and more."""
    shared = F.size(F.array_intersect(*(F.regexp_extract_all(x, F.lit("[a-z0-9]{4,}"), 0) for x in (left, right))))
    opposite = F.lit(False)
    for yes, no in POLARITY:
        opposite = opposite | (left.contains(yes) & right.contains(no)) | (left.contains(no) & right.contains(yes))
    return opposite & (shared >= 2)
