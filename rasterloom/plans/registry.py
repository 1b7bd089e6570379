"""Registered queries: one for each operator, with SQL for the same rows where SQL can say it.

Grids are made of the events table, 100 cells wide: cell (event_id % 100, event_id div 100).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources.grids import GridSpec, cells_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WIDTH = 100


def registered(name: str, sql: str | None = None):
    """Enters a query, and its SQL, under a name."""

    def enter(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_grid(spark: SparkSession, sf_dir: str, *values: str) -> DataFrame:
    return cells_of(table(spark, sf_dir, "events"), "event_id", WIDTH, *values)


def event_spec(spark: SparkSession, sf_dir: str) -> GridSpec:
    top = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return GridSpec(WIDTH, (top or 0) // WIDTH + 1)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to fixed digits, so that two engines' sums compare; without a negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


from rasterloom.plans import queries_cells, queries_flow, queries_tables  # noqa: E402, F401  they enter their queries here
