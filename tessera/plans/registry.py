"""The registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.views import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers plan(inputs) -> DataFrame under this name; sql may use the views."""

    def register(plan: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return plan

    return register
