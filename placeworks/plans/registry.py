"""Where queries are registered: a function of the tables' roles, and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placeworks.plans.roles import Tables, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(make: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = make.__name__, make.__doc__
        QUERIES[make.__name__] = run
        if sql:
            ORACLE_SQL[make.__name__] = with_roles(sql)
        return make

    return register
