"""Numbers of a text, in digits or words, with their units, clauses and what they count.

Spark's functions do not say where a pattern stands, so this runs in tasks
over Arrow batches; texts without a number never get here.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .ledger import SMALL_NUMBERS, TENS

#: Words of numbers, units, signs of money, what asks for years or money, and what ends a counted thing.
VALUES = {w: i for i, w in enumerate(SMALL_NUMBERS)} | {w: 10 * (i + 2) for i, w in enumerate(TENS)} | {"dozen": 12}
NUMBER_WORDS = {*VALUES, "hundred", "thousand", "and"}
UNITS = set(
    "cup cups day days dollar dollars engineer engineers euro euros follower followers foot feet gallon gallons hour hours liter liters litre litres item items "
    "kilometer kilometers km meter meters mile miles minute minutes month months person people pound pounds session sessions week weeks year years".split()
)
MONEY = {"$": "dollars", "€": "euros", "£": "pounds"}
YEARS = re.compile(r"\b(age|aged|older|year-old|years old|birthday|turned|mom|mother|dad|father|parent|parents|grandparent|grandparents)\b")
PRICES = re.compile(r"[$€£]|\b(spent|cost|costs|price|paid|budget|fare|worth)\b")
DIGITS = re.compile(r"(?<![\w.])(-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(?:s\b)?(?![\w.])")
CLAUSE_ENDS = re.compile(r"[;.!?]|,?\s+\b(?:but|whereas|while)\b\s+", re.I)
COUNTS = re.compile(r"\b(?:i|we)\s+(?:(?:now|currently|recently|just)\s+)?(?:have|own|lead|visited|watched|completed|attended|bought|read|met|tried|saw)\s*$", re.I)
HOLDS = re.compile(r"\b(?:i|we)\s+(?:(?:now|currently)\s+)?(?:have|own|lead)\s*$", re.I)
THING_ENDS = set("and are at because but contain contains did during for from had has in on that the this those was were which who with".split())
#: One word for its likes.
CATEGORIES = {"attorney": "attorney", "lawyer": "attorney", "clinician": "doctor", "doctor": "doctor", "physician": "doctor", "academic": "professor", "professor": "professor", "counselor": "therapist", "therapist": "therapist"}

QUANTITY = "struct<value:double,unit:string,role:string,begins:int,ends:int,context:string,category:string,snapshot:boolean>"
HAS_NUMBER = rf"(?i)\d|\b({'|'.join(sorted(NUMBER_WORDS - {'and'}))})\b"


#: Endings that a name loses, the first that leaves four letters at least, and words that keep their s.
ENDINGS, KEEPS_S = ("ies", "ing", "ed", "es", "s"), ("ss", "is", "us")


def canonical(word: str) -> str:
    """A word without case and ending."""
    low = word.lower()
    for ending in ENDINGS:
        if low.endswith(ending) and len(low) - len(ending) > 3 and not (ending == "s" and low.endswith(KEEPS_S)):
            return low.removesuffix(ending) + "y" * (ending == "ies")
    return low


def worded(words: list[str]) -> float | None:
    """The value of a run of number words."""
    total, now, any_ = 0, 0, False
    for w in words:
        if w == "and":
            continue
        any_ = True
        if w == "hundred":
            now = max(1, now) * 100
        elif w == "thousand":
            total, now = total + max(1, now) * 1000, 0
        else:
            now += VALUES[w]
    return float(total + now) if any_ else None


def _unit(text: str, begins: int, ends: int) -> str:
    before, after = text[:begins].rstrip(), text[ends:].lstrip(" -–—")
    if before[-1:] in MONEY:
        return MONEY[before[-1]]
    if after.startswith("%"):
        return "percent"
    named = re.match(r"[A-Za-z][A-Za-z_/-]{0,30}", after)
    if named and named[0].lower() in UNITS:
        return named[0].lower()
    low = text.lower()
    return "years" if YEARS.search(low) else "currency" if PRICES.search(low) else "number"


def _context(text: str, begins: int, ends: int) -> str:
    edges = [0, len(text), *(x for m in CLAUSE_ENDS.finditer(text) for x in m.span())]
    return text[max(e for e in edges if e <= begins) : min(e for e in edges if e >= ends)].strip(" ,;.!?-") or text


def _counted(text: str, ends: int) -> str:
    """The name of the thing that follows a number: the last of at most five words before a small word."""
    words = []
    for w in re.findall(r"[A-Za-z]+", text[ends:])[:5]:
        if w.lower() in THING_ENDS:
            break
        words.append(w)
    return canonical(words[-1]) if words else ""


def quantities(text: str | None) -> list[dict]:
    """Each number of ``text``, in order."""
    spans = [(m.start(), m.end(), float(m[1].replace(",", ""))) for m in DIGITS.finditer(text or "")]
    taken, run = list(spans), []
    for m in [*re.finditer(r"[A-Za-z]+", text or ""), None]:
        if m and m[0].lower() in NUMBER_WORDS and (run or m[0].lower() != "and"):
            run.append(m)
            continue
        if run:
            begins, ends, value = run[0].start(), run[-1].end(), worded([x[0].lower() for x in run])
            if value is not None and not any(begins < z and a < ends for a, z, _ in taken):
                spans.append((begins, ends, value))
        run = []
    out = []
    for begins, ends, value in sorted(spans):
        thing = _counted(text, ends) if COUNTS.search(text[:begins]) else ""
        out.append(
            {
                "value": value, "unit": thing or _unit(text, begins, ends), "role": "declared_cardinality" if thing else "mentioned_quantity", "begins": begins, "ends": ends,
                "context": _context(text, begins, ends), "category": thing or None, "snapshot": bool(thing and HOLDS.search(text[:begins])),
            }
        )
    return out


def quantities_of(text: Column) -> Column:
    """array<struct> of the numbers of each text; empty without one."""

    @F.pandas_udf(f"array<{QUANTITY}>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(quantities)

    return read(F.when(text.rlike(HAS_NUMBER), text))
