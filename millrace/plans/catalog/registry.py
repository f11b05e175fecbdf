"""Registry of the example queries and of the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where plain SQL can say the same."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"Query '{name}' is registered twice.")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(name: str) -> Column:
    """A double as an exact decimal, so that sums do not depend on their order."""
    return F.col(name).cast("decimal(18,2)")
