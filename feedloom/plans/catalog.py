"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.session import ship_package
from feedloom.plans import q_daily, q_docs, q_entries, q_html, q_links, q_misc, q_state, q_stream

MODULES = [q_entries, q_html, q_state, q_links, q_docs, q_stream, q_misc, q_daily]


def _shipped(fn):
    """Wrap a query so the package is importable by Python workers first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {}
    for m in MODULES:
        out.update({name: _shipped(fn) for name, fn in m.QUERIES.items()})
    return out


def oracle_sql() -> dict[str, str]:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(m, "SQL", {}))
    return out
