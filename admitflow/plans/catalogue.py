"""Registry of the catalogue queries and their SQL twins."""

from __future__ import annotations

from functools import wraps

from admitflow.session import ship

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a (spark, sf_dir) -> DataFrame query, with the SQL that must give the same rows."""

    def add(f):
        @wraps(f)
        def query(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[name] = query
        if sql:
            _ORACLES[name] = sql
        return query

    return add


def _load() -> None:
    from admitflow.plans import belief_queries, corpus_queries, driver_queries, metric_queries, scalar_queries, source_queries, stream_queries  # noqa: F401


def queries() -> dict:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES
