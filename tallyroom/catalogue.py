"""All queries over the engine's own operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from tallyroom.plans import auditing, classification, deriving, forms, keys, match

_MODULES = (match, classification, auditing, deriving, keys, forms)


def queries() -> dict[str, Callable]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLE.items()}
