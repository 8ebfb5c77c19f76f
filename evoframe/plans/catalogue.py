"""The registered queries and the SQL they are held against. A query without SQL is tested in tests/ instead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evoframe.plans.views import with_views
from evoframe.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            # Fixed values of the other engine's dialect: maps keep the last of equal keys, times are in UTC.
            spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        key = name or f.__name__
        QUERIES[key] = call
        if sql:
            ORACLES[key] = with_views(sql)
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from evoframe.plans import query_population, query_storage, query_text, query_verification  # noqa: F401  they register

    return QUERIES, ORACLES
