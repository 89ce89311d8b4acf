"""Named whole-table queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from deckloom.plans.view_sql import with_views
from deckloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(run)
        def tuned(spark: SparkSession, sf: str) -> DataFrame:
            tune(spark)
            return run(spark, sf)

        QUERIES[name] = tuned
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return run

    return register
