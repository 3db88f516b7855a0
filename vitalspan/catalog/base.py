"""Registry of the queries that run on the given tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def six(c: Column, name: str) -> Column:
    return F.round(c.cast("double"), 6).alias(name)


HOUR = 3600
DAY = 86_400

# Parameters that fit the density of the given event table.
EVENT_GAP = 6 * HOUR
EVENT_EPISODE_GAP = 2 * DAY
EVENT_WINDOW = 12 * HOUR
EVENT_SALT = "salt"


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Dates and nullable flags as text, which compares the same in every engine."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Nullable counts as double, which compares the same in every engine."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})
