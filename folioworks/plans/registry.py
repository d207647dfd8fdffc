"""The registered queries: a name, a function of the views, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioworks.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of `view` (name -> DataFrame) under its own name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(fixtures.view(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = fixtures.oracle(sql)
        return f

    return add
