"""Signal cleaning on a regular grid.

Every subject is first aligned to a grid of a fixed number of points, so each later
window runs over a group whose size is known in advance.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.functions.dates import MICROS, epoch_micros, plus_seconds
from vitalspan.functions.signal import RATE_HIGH, RATE_LOW
from vitalspan.operators.skew import join_per_key

# Filter parameters.
HAMPEL_SECONDS = 2.0
HAMPEL_SIGMAS = 3.0
MAD_TO_SIGMA = 1.4826
SPIKE_JUMP = 20.0
MAX_GAP_SECONDS = 2.0
PROCESS_VARIANCE = 1.0
MEASUREMENT_VARIANCE = 4.0
FIRST_VARIANCE = 1.0

POSITION, FILTERED = "position", "filtered"


def merge_instants(rows: DataFrame, key: str, ts: str, values: Sequence[str]) -> DataFrame:
    """One row per (key, time): the mean of each signal over rows with the same time."""
    means = [F.avg(F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double"))).alias(v) for v in values]
    return rows.dropna(subset=[key, ts]).groupBy(key, ts).agg(*means)


def out_of_range(value: Column, low: float = RATE_LOW, high: float = RATE_HIGH) -> Column:
    return value.isNull() | ~value.between(low, high)


def grid_align(
    rows: DataFrame,
    key: str,
    ts: str,
    rate: str,
    step_seconds: float,
    points: int,
    others: Sequence[str] = (),
    low: float = RATE_LOW,
    high: float = RATE_HIGH,
) -> DataFrame:
    """Each subject on ``points`` regular instants that end at its last plausible reading.

    Rows off the grid are dropped and missing instants appear with NULL signals; the
    ``filtered`` flag marks missing and implausible readings.
    """
    merged = merge_instants(rows, key, ts, [rate, *others])
    implausible = out_of_range(F.col(rate), low, high)
    ends = (
        merged.groupBy(key).agg(F.max(F.when(~implausible, F.col(ts))).alias("_end")).where(F.col("_end").isNotNull())
    )
    step = int(round(step_seconds * MICROS))
    placed = join_per_key(merged, ends, key, spread_by=[ts]).withColumn(
        "_back", epoch_micros(F.col("_end")) - epoch_micros(F.col(ts))
    )
    last = points - 1
    on_grid = placed.where((F.col("_back") % step == 0) & F.col("_back").between(0, last * step))
    signals = [rate, *others]

    def point(position: Column, present: Column) -> Column:
        return F.struct(position.alias(POSITION), *[F.when(present, F.col(c)).alias(c) for c in signals])

    # Exactly one row of each subject, its last plausible reading, stands for the whole grid.
    own = (F.lit(last) - F.col("_back") / step).cast("int")
    whole_grid = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda p: point(p, p == last))
    spread = F.when(F.col("_back") == 0, whole_grid).otherwise(F.array(point(own, F.lit(True))))
    points_of = on_grid.select(key, "_end", F.explode(spread).alias("_point")).select(key, "_end", "_point.*")
    full = points_of.groupBy(key, POSITION).agg(
        F.max("_end").alias("_end"), *[F.max(c).alias(c) for c in signals]
    )
    instant = plus_seconds(F.col("_end"), (F.col(POSITION) - last) * F.lit(step_seconds))
    return full.select(key, POSITION, instant.alias(ts), *signals, implausible.alias(FILTERED))


def _by_position(key: str) -> Window:
    return Window.partitionBy(key).orderBy(POSITION)


def _usable(rate: str) -> Column:
    return F.when(~F.col(FILTERED), F.col(rate))


def window_points(step_seconds: float, seconds: float = HAMPEL_SECONDS) -> int:
    return max(3, 2 * round(seconds / step_seconds) + 1)


def hampel(
    rows: DataFrame,
    key: str,
    rate: str,
    step_seconds: float,
    sigmas: float = HAMPEL_SIGMAS,
    window_seconds: float = HAMPEL_SECONDS,
) -> DataFrame:
    """Flag readings far from the median of their centred window.

    Both the median and the median deviation need a complete window.
    """
    points = window_points(step_seconds, window_seconds)
    half = points // 2
    frame = _by_position(key).rowsBetween(-half, half)

    def centred_median(values: Column) -> Column:
        inside = F.collect_list(values).over(frame)
        return F.when(F.size(inside) == points, F.sort_array(inside)[half])

    measured = rows.withColumn("_median", centred_median(_usable(rate)))
    measured = measured.withColumn("_deviation", F.abs(_usable(rate) - F.col("_median")))
    measured = measured.withColumn("_mad", centred_median(F.col("_deviation")))
    outlier = F.coalesce(F.col("_deviation") > F.col("_mad") * (sigmas * MAD_TO_SIGMA), F.lit(False))
    return measured.withColumn(FILTERED, F.col(FILTERED) | outlier).select(*rows.columns)


def spikes(rows: DataFrame, key: str, rate: str, jump: float = SPIKE_JUMP) -> DataFrame:
    """Flag readings that jump away from both neighbours, flagged neighbours included."""
    order = _by_position(key)
    value = F.col(rate)
    lonely = (F.abs(value - F.lag(rate).over(order)) > jump) & (F.abs(value - F.lead(rate).over(order)) > jump)
    return rows.withColumn(FILTERED, F.col(FILTERED) | F.coalesce(lonely, F.lit(False)))


def interpolate_short(
    rows: DataFrame, key: str, rate: str, step_seconds: float, max_gap_seconds: float = MAX_GAP_SECONDS
) -> DataFrame:
    """Fill gaps between usable readings linearly, at most the first points of each gap."""
    limit = max(1, round(max_gap_seconds / step_seconds))
    known = F.when(~F.col(FILTERED) & F.col(rate).isNotNull(), F.struct(F.col(POSITION).alias("at"), F.col(rate).alias("v")))
    forward = _by_position(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = (
        Window.partitionBy(key).orderBy(F.col(POSITION).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    framed = rows.withColumns(
        {"_left": F.last(known, ignorenulls=True).over(forward), "_right": F.last(known, ignorenulls=True).over(backward)}
    )
    left, right = F.col("_left"), F.col("_right")
    share = (F.col(POSITION) - left["at"]) / (right["at"] - left["at"])
    value = left["v"] + (right["v"] - left["v"]) * share
    near = (F.col(POSITION) - left["at"]) <= limit
    filled = F.coalesce(F.col(FILTERED) & near & right.isNotNull(), F.lit(False))
    return framed.select(
        *[c for c in rows.columns if c not in (rate, FILTERED)],
        F.when(filled, value).otherwise(F.col(rate)).alias(rate),
        (F.col(FILTERED) & ~filled).alias(FILTERED),
    ).select(*rows.columns)


def kalman_smooth(rows: DataFrame, key: str, rate: str) -> DataFrame:
    """Scalar Kalman filter over the grid of each subject; NULL where filtered.

    The estimate depends on all readings before it.  The grid of a subject (a fixed number
    of points) becomes one array, and a batch of subjects is smoothed step by step at once.
    """
    q, r, first = PROCESS_VARIANCE, MEASUREMENT_VARIANCE, FIRST_VARIANCE

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def smooth(series: pd.Series) -> pd.Series:
        import numpy as np
        import pandas as pd

        grid = np.vstack([np.asarray(s, dtype=float) for s in series]) if len(series) else np.empty((0, 0))
        out = np.full_like(grid, np.nan)
        estimate = np.full(len(grid), np.nan)
        variance = np.full(len(grid), first)
        for step in range(grid.shape[1]):
            value = grid[:, step]
            begun, seen = ~np.isnan(estimate), ~np.isnan(value)
            variance = np.where(begun, variance + q, variance)
            gain = variance / (variance + r)
            estimate = np.where(seen, np.where(begun, estimate + gain * (value - estimate), value), estimate)
            variance = np.where(seen & begun, (1.0 - gain) * variance, variance)
            out[:, step] = np.where(seen, estimate, np.nan)
        return pd.Series(list(out))

    others = [c for c in rows.columns if c not in (key, rate)]
    item = F.struct(F.col(POSITION).alias("_at"), *others, _usable(rate).cast("double").alias("_value"))
    grids = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_grid"))
    smoothed = grids.select(key, "_grid", smooth(F.col("_grid._value")).alias("_smooth"))
    steps = smoothed.select(key, F.explode(F.arrays_zip("_grid", "_smooth")).alias("_step"))
    value = F.col("_step._smooth")
    return steps.select(
        key, *[F.col(f"_step._grid.{c}").alias(c) for c in others], F.when(~F.isnan(value), value).alias(rate)
    ).select(*rows.columns)


def keep_complete(rows: DataFrame, key: str, min_share: float = 0.5) -> DataFrame:
    """Subjects with at least this share of unfiltered grid points."""
    share = F.avg(F.when(F.col(FILTERED), 0.0).otherwise(1.0)).over(Window.partitionBy(key))
    return rows.withColumn("_share", share).where(F.col("_share") >= min_share).drop("_share")


def denoise(
    rows: DataFrame,
    key: str,
    ts: str,
    rate: str,
    others: Iterable[str] = (),
    step_seconds: float = 1.0,
    points: int = 3600,
    min_share: float = 0.5,
    window_seconds: float = HAMPEL_SECONDS,
    max_gap_seconds: float = MAX_GAP_SECONDS,
) -> DataFrame:
    """Range check, grid, Hampel, spikes, short gaps, Kalman, and the completeness filter."""
    grid = grid_align(rows, key, ts, rate, step_seconds, points, list(others))
    cleaned = hampel(grid, key, rate, step_seconds, window_seconds=window_seconds)
    cleaned = spikes(cleaned, key, rate)
    cleaned = interpolate_short(cleaned, key, rate, step_seconds, max_gap_seconds)
    return kalman_smooth(keep_complete(cleaned, key, min_share), key, rate)
