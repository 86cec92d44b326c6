"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from . import building, contracts, matching, problems, structure

_MODULES = (problems, structure, matching, building, contracts)


def queries() -> dict[str, Callable]:
    out: dict[str, Callable] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.ORACLE
    return out
