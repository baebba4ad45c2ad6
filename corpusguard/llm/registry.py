"""The queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from corpusguard.llm import chaining, ctw, decontaminate, ftrl, licenses, minhash, mixing, rindex, rules, sharding

MODULES = (ctw, mixing, chaining, rindex, ftrl, minhash, rules, sharding, decontaminate, licenses)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
