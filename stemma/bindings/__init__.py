"""The queries of the core library on the generic tables, each with its SQL beside it."""

from __future__ import annotations

from . import evidence, feed, family, linkage, media, readmodel, routes, visibility

_MODULES = (evidence, visibility, family, linkage, media, feed, readmodel, routes)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
