"""Duplicate instants: rate filter and one voted row per instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.signal import TOCO_HIGH, TOCO_LOW, real_number
from vitalspan.operators.skew import join_per_key


def median_positive(value: str) -> Column:
    """Median of the positive readings, 0 when there is none; NaN does not vote."""
    reading = real_number(F.col(value))
    return F.coalesce(F.median(F.when(reading > 0, reading)), F.lit(0.0)).cast("float")


def median_plausible(value: str, low: float = TOCO_LOW, high: float = TOCO_HIGH) -> Column:
    """Median of the plausible readings, else of all readings; NaN does not vote."""
    reading = real_number(F.col(value))
    plausible = F.when(reading.between(low, high), reading)
    return F.coalesce(F.median(plausible), F.median(reading)).cast("float")


def most_common(value: str) -> Column:
    """Most frequent level; the lowest one on ties; NULL when all are missing."""
    return F.mode(value, True)


def duplicate_rates(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key: distinct instants, instants seen more than once, and their ratio."""
    per_instant = rows.dropna(subset=[key]).groupBy(key, ts).agg(F.count(F.lit(1)).alias("_n"))
    sums = per_instant.groupBy(key).agg(
        F.sum(F.when(F.col("_n") > 1, 1).otherwise(0)).alias("dup_ts"), F.count(F.lit(1)).alias("total_ts")
    )
    return sums.withColumn("dup_rate", F.col("dup_ts") * 1.0 / F.col("total_ts"))


def drop_noisy_keys(rows: DataFrame, key: str, ts: str, max_rate: float) -> DataFrame:
    """Rows of the keys whose duplicate rate is at most ``max_rate``."""
    keep = duplicate_rates(rows, key, ts).where(F.col("dup_rate") <= max_rate).select(key)
    return join_per_key(rows, keep, key, spread_by=[ts], how="left_semi")


def vote_per_instant(
    rows: DataFrame, key: Sequence[str], rate: str, toco: str, levels: Sequence[str], first: Sequence[str] = ()
) -> DataFrame:
    """One row per instant: voted signals, voted levels and the lowest value of ``first``.

    The aggregation state of a group is a count per distinct reading, so it is bounded
    by the resolution of the sensor and not by the number of copies.
    """
    return rows.groupBy(*key).agg(
        *[F.min(c).alias(c) for c in first],
        median_positive(rate).alias(rate),
        median_plausible(toco).alias(toco),
        *[most_common(c).alias(c) for c in levels],
    )
