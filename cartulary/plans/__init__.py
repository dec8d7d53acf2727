"""The registered queries of the crosswalk operators, by module."""

from __future__ import annotations

from collections.abc import Callable


def _modules() -> list:
    from cartulary.plans import crosswalk, facts, stores, texts

    return [crosswalk, facts, stores, texts]


def queries() -> dict[str, Callable]:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLE.items()}
