"""All queries over the driver's tables, each with its SQL where SQL can express it."""

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("scalars", "ingesting", "extracting", "relating", "graphs", "texts", "times", "curating", "streams", "files")


def query(name: str, sql: str | None = None):
    """Register f(t) for a name; t gives the tables and bindings of a data folder (see bindings.Tables)."""

    def add(f):
        from edgeloom.plans.bindings import Tables

        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"edgeloom.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
