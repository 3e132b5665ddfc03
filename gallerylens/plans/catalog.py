"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from . import documents, events, graph, sets, vectors


def queries() -> dict[str, Callable]:
    return {k: f for m in (vectors, graph, documents, sets, events) for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in (vectors, graph, documents, sets, events) for k, s in m.R.oracles.items()}
