"""All registered queries of the engine and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with equivalent SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import answers, bundled, chunks, compiled, consolidated, entities, evidence, files, flowing, imports, marked, packs, paths, planned, project, reduce, relational, retrieval, sessions, stores, text, upkeep  # noqa: E402,F401  (they register their queries)
