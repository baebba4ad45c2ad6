"""All queries of the engine proper and the SQL that checks them."""

from __future__ import annotations

from corpusguard.plans import answers, detection, search

_ALL = {**detection.QUERIES, **search.QUERIES, **answers.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
