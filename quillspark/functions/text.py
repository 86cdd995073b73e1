"""Column functions over text: tokens, chunks, estimates, classes and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zA-Z0-9][a-zA-Z0-9_-]{1,}"
#: Words that are no keywords.
STOP_WORDS = "about after also been before being between both could does each from have into more most only other over same should some such than that their them then there these they this those through under very were what when where which while will with would your".split()
CHUNK_WORDS, CHUNK_OVERLAP = 180, 40
#: Weight of a source by its class, and by the trust in it.
CLASS_WEIGHT = {"document": 1.0, "artifact": 0.85, "transcript": 0.72, "chat": 0.65}
TRUST_WEIGHT = {"low": 0.55, "medium": 0.85}
#: How secrets and personal data are masked, in order.
REDACTIONS = (
    (r"(?i)bearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]"),
    (r"(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*[^\s,;]+", "$1=[redacted]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),
    (r"(https?://)[^/\s:@]+:[^/\s@]+@", "$1[redacted]@"),
)
#: What a line of boilerplate says.
BOILERPLATE = "(cookie|subscribe|all rights reserved|sign in|privacy policy|licensed under|terms of (use|service))"


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Retrieval tokens, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), F.lower)


def keyword_tokens(text: Column) -> Column:
    """Lower-cased words of four ASCII letters or more that are not stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), 0)
    return F.filter(found, lambda t: ~t.isin(STOP_WORDS))


def keyword_set(text: Column) -> Column:
    """The different ones of ``keyword_tokens``, in order of their first place."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{4,}"), 0)
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def words(text: Column) -> Column:
    """Words between runs of spaces, tabs and line ends."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+"), lambda w: w != "")


def word_chunks(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` words, each beginning ``size - overlap`` after the last; the window that reaches the end is the last."""

    def chunks(w):
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / F.lit(size - overlap))).cast("int")
        some = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(w, k * (size - overlap) + 1, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(some)

    return bound(words(text), chunks)


def line_chunks(text: Column, size: int = 80) -> Column:
    """Runs of ``size`` lines; the last has the rest."""

    def chunks(lines):
        last = F.floor((F.size(lines) - 1) / F.lit(size)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(lines, k * size + 1, size), "\n"))

    return bound(F.split(text, "\n"), chunks)


def squeezed(text: Column) -> Column:
    """White space of ASCII as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(squeezed(text).cast("binary"), 256)


def token_estimate(text: Column) -> Column:
    """The larger of a quarter of the characters and 1.15 times the word pieces; 1 at least."""
    t = squeezed(text)
    pieces = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+|[^ A-Za-z0-9]"), 0))
    return F.greatest(F.lit(1), F.floor(F.length(t) / 4), F.ceil(pieces * F.lit(1.15))).cast("long")


def sentences(text: Column) -> Column:
    """Sentences end at ``.``, ``!`` or ``?`` before white space."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), "(?<=[.!?])[ \\t\\n\\r]+")
    return F.filter(parts, lambda s: s != "")


def content_profile(text: Column) -> Column:
    """First profile whose mark the text has."""
    return (
        F.when(text.rlike(r"^[ \n]*[{\[]"), "json")
        .when(text.rlike(r"(?m)^(diff --git|@@ )"), "diff")
        .when(text.rlike(r"(?m)^#{1,6} "), "markdown")
        .when(text.rlike(r"(?m)^(user|assistant|system):"), "conversation")
        .when(text.rlike(r"(?m)^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), "log")
        .when(text.rlike(r"\|.*\|.*\|"), "table")
        .when(text.rlike(r"(def |function |class )[A-Za-z_]+"), "code")
        .otherwise("prose")
    )


def redacted(text: Column) -> Column:
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def class_weight(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CLASS_WEIGHT.items() for x in kv)), kind), F.lit(1.0))


def trust_weight(tier: Column, labels: Column) -> Column:
    """Low trust by tier or label counts 0.55, medium 0.85, else 1."""
    low = (tier == "low") | F.arrays_overlap(labels, F.array(F.lit("untrusted"), F.lit("hostile")))
    return F.when(low, TRUST_WEIGHT["low"]).when(tier == "medium", TRUST_WEIGHT["medium"]).otherwise(1.0)


def content_lines(lines: Column) -> Column:
    """The lines that are neither blank nor boilerplate."""
    return F.filter(lines, lambda x: (F.trim(x) != "") & ~F.lower(x).rlike(BOILERPLATE))


def family_name(name: Column) -> Column:
    """Lower-cased, kind suffixes and decimals of versions dropped, other runs as one dash."""
    t = F.regexp_replace(F.lower(name), "[-_ ](instruct|chat|base|it)$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "([0-9]+)\\.[0-9]+", "$1"), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def billions(name: Column) -> Column:
    """Size that a name gives as ``7b``; null if none."""
    return F.nullif(F.regexp_extract(F.lower(name), "([0-9]+)b\\b", 1), F.lit("")).cast("double")
