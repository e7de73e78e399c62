"""The operators run over the generic star-schema tables, each beside an equivalent SQL text.

`queries()` and `oracle_sql()` collect the cases of every module. Tables play the domain roles
described in `roles`.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("votes", "period", "money", "social", "places", "search", "audit", "composites", "files")


def _collect(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"{__name__}.{name}"), attribute))
    return out


def queries() -> dict:
    """Query name to `(spark, folder) -> DataFrame`."""
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    """Query name to the equivalent SQL text."""
    return _collect("ORACLE")
