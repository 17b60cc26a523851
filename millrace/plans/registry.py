"""Registry of queries: a name, a Spark plan over the given tables, and SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[["Tables"], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on first use as ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name``, with its SQL where SQL can express it."""

    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def runnable(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: plan(Tables(spark, folder))
