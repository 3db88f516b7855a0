"""Whole-key filters on signal content and on key uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.skew import join_per_key


def keys_with_enough(rows: DataFrame, key: str, condition: Column, minimum: int) -> DataFrame:
    """Keys with at least ``minimum`` rows that meet the condition."""
    hits = rows.dropna(subset=[key]).groupBy(key).agg(F.sum(F.when(condition, 1).otherwise(0)).alias("n_hits"))
    return hits.where(F.col("n_hits") >= minimum)


def keep_informative(rows: DataFrame, key: str, ts: str, condition: Column, minimum: int) -> DataFrame:
    keep = keys_with_enough(rows, key, condition, minimum).select(key)
    return join_per_key(rows, keep, key, spread_by=[ts], how="left_semi")


def with_anchor_date(rows: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """Add the date of the last row of each key."""
    anchors = rows.dropna(subset=[key]).groupBy(key).agg(F.max(ts).cast("date").alias(name))
    return join_per_key(rows, anchors, key, spread_by=[ts])


def duplicated_keys(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows themselves; reading them fails when a key occurs twice.  No job runs before that.

    Only the key is counted, with a combine on the map side; the rows are not shuffled.
    """
    twice = duplicated_keys(rows.select(key).dropna(), [key]).agg(F.min(F.col(key).cast("string"))).scalar()
    failure = F.raise_error(F.concat(F.lit(f"duplicate {key} rows: "), twice)).cast("boolean")
    return rows.where(F.when(twice.isNull(), F.lit(True)).otherwise(failure))
