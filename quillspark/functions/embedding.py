"""Signed feature hashing of tokens into a fixed vector."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .text import TOKEN

DIMENSIONS = 128


#: Places of tokens that a worker keeps.
KEPT = 1 << 16


def _place(token: str, _kept: dict[str, tuple[int, float]] = {}) -> tuple[int, float]:  # noqa: B006  (a plain dict travels to workers by value)
    """The first four bytes of an 8-byte blake2b digest, and a sign by the parity of the fifth."""
    out = _kept.get(token)
    if out is None:  # a batch says the same words again and again
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        out = int.from_bytes(h[:4], "big"), 1.0 if h[4] % 2 == 0 else -1.0
        if len(_kept) >= KEPT:
            _kept.clear()
        _kept[token] = out
    return out


def hash_vector(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed counts of the text's tokens by their bucket; unit length."""
    out = np.zeros(dimensions)
    for t in re.findall(TOKEN, text or ""):
        at, sign = _place(t.lower())
        out[at % dimensions] += sign
    n = np.linalg.norm(out)
    return (out / n if n else out).tolist()


def hash_embedding():
    """Pandas UDF text -> array<double>."""

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        return s.map(hash_vector)

    return embed
