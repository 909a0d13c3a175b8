"""Registered queries and their SQL."""

from corvane.plans import audio, catalog, signals, tokens, vectors

MODULES = [signals, audio, vectors, tokens, catalog]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
