"""Registered queries: each binds an operator to the given tables.

``REGISTRY`` maps a name to ``(function(spark, sf_dir) -> DataFrame, SQL or None)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return add


def rounded(column):
    """Nine digits: means of two-digit figures seldom end half-way between two of those."""
    from pyspark.sql import functions as F

    return F.round(column, 9)


def load_all() -> dict[str, tuple[Query, str | None]]:
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
