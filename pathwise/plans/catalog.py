"""Registry of named queries and their independent SQL oracles.

Each registered query is ``fn(spark, sf_dir) -> DataFrame`` over the
driver's tables; the oracle is DuckDB-runnable SQL over the same tables.
Modules under ``pathwise.plans`` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pathwise.sources.oracle_views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Decorator: register a query under ``name`` with an optional oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views) if views else sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its registrations run."""
    from pathwise.plans import (  # noqa: F401
        q_features, q_scoring, q_candidates, q_ranking, q_events, q_eval, q_streaming, q_knn, q_models, q_sources, q_jobs,
    )
