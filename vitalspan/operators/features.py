"""Aggregate features of each subject's series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.dates import duration_seconds
from vitalspan.operators.cells import with_previous
from vitalspan.operators.histograms import quantile_columns
from vitalspan.operators.quantiles import exact_quantiles

QUANTILES = {"q10": 0.10, "q50": 0.50, "q90": 0.90}

# The published feature names, in order.
FEATURE_NAMES = [
    "n_rows", "duration_seconds",
    "fhr_mean", "fhr_std", "fhr_min", "fhr_max", "fhr_zero_frac", "fhr_nonzero_mean", "fhr_nonzero_std",
    "fhr_q10", "fhr_q50", "fhr_q90",
    "toco_mean", "toco_std", "toco_min", "toco_max", "toco_q10", "toco_q50", "toco_q90",
    "fhr_abs_diff_mean", "toco_abs_diff_mean",
]


def absolute_steps(
    rows: DataFrame, key: str, ts: str, values: dict[str, str], cell_seconds: float, tie: list[str] | None = None
) -> DataFrame:
    """Add |value - previous value| in time order; ``values`` maps new names to columns."""
    before = {f"_before_{new}": column for new, column in values.items()}
    rows = with_previous(rows, [key], ts, before, cell_seconds, tie=tie or [])
    steps = [F.abs(F.col(column) - F.col(f"_before_{new}")).alias(new) for new, column in values.items()]
    return rows.select(*[c for c in rows.columns if not c.startswith("_before_")], *steps)


def _spread(c: Column, prefix: str) -> list[Column]:
    return [
        F.avg(c).alias(f"{prefix}_mean"),
        F.stddev_samp(c).alias(f"{prefix}_std"),
        F.min(c).alias(f"{prefix}_min"),
        F.max(c).alias(f"{prefix}_max"),
    ]


def aggregate_features(
    rows: DataFrame,
    key: str = "BabyID",
    ts: str = "Timestamp",
    rate: str = "FHR",
    toco: str = "toco",
    cell_seconds: float = 3600,
    tie: list[str] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Key and 21 features per subject, in double precision.

    ``bounded``: no subject has more rows than a task can order, as after the reduction, where it
    holds one closing window.  Steps, moments and quantiles then come from one exchange by subject.
    """
    tie = tie or []
    series = rows.select(
        key, ts, *tie, F.col(rate).cast("double").alias("fhr"), F.col(toco).cast("double").alias("toco")
    )
    steps = {"fhr_abs_diff": "fhr", "toco_abs_diff": "toco"}
    if bounded:
        in_time = Window.partitionBy(key).orderBy(ts, *tie)
        changes = {new: F.abs(F.col(c) - F.lag(c).over(in_time)) for new, c in steps.items()}
        stepped = series.dropna(subset=[key, ts]).withColumns(changes)
    else:
        stepped = absolute_steps(series, key, ts, steps, cell_seconds, tie=tie)
    positive = F.when(F.col("fhr") > 0, F.col("fhr"))
    wanted = {f"{c}_{q}": (c, p) for c in ("fhr", "toco") for q, p in QUANTILES.items()}
    plain = stepped.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        duration_seconds(F.min(ts), F.max(ts)).alias("duration_seconds"),
        *_spread(F.col("fhr"), "fhr"),
        F.avg(F.when(F.col("fhr") == 0, 1.0).otherwise(0.0)).alias("fhr_zero_frac"),
        F.avg(positive).alias("fhr_nonzero_mean"),
        F.stddev_samp(positive).alias("fhr_nonzero_std"),
        *_spread(F.col("toco"), "toco"),
        F.avg("fhr_abs_diff").alias("fhr_abs_diff_mean"),
        F.avg("toco_abs_diff").alias("toco_abs_diff_mean"),
        *(quantile_columns(wanted) if bounded else []),
    )
    if bounded:
        return plain.select(key, *FEATURE_NAMES)
    quantiles = exact_quantiles(series, [key], wanted, spread_by=[ts])
    return plain.join(quantiles, key, "left").select(key, *FEATURE_NAMES)


def as_model_types(features: DataFrame, key: str = "BabyID") -> DataFrame:
    """Features in single precision, the row count as int."""
    kinds = {name: "int" if name == "n_rows" else "float" for name in FEATURE_NAMES}
    return features.select(key, *[F.col(n).cast(t).alias(n) for n, t in kinds.items()])
