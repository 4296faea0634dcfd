"""Names of the queries, each with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from docketry.plans.carriers import Carriers

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the carriers under its name, with its SQL."""

    def register(f: Callable[[Carriers], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Carriers(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register
