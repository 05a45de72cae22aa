"""The registered queries, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.catalog.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query over the tables of a directory."""
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name -> SQL over tables of the same names."""
    _load()
    return dict(SQL)


def _load() -> None:
    from tracewright.catalog import branches, cleaning, model, reports, sequences, statistics  # noqa: F401
