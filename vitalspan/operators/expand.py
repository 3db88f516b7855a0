"""Between one row per second and one row per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import plus_seconds
from vitalspan.functions.signal import SAMPLES_PER_SECOND, one_hz_value


def expand_samples(
    rows: DataFrame, ts: str, signals: dict[str, Column], per_second: int = SAMPLES_PER_SECOND
) -> DataFrame:
    """One row per sample: ``signals`` maps output names to arrays of samples.

    Sample i of a second is i / per_second seconds after it.
    """
    zipped = F.arrays_zip(*[a.alias(n) for n, a in signals.items()])
    kept = [c for c in rows.columns if c not in signals]
    wide = rows.where(F.col(ts).isNotNull()).select(*kept, F.posexplode(zipped).alias("sample", "_values"))
    moved = plus_seconds(F.col(ts), F.col("sample") * F.lit(1.0 / per_second))
    return wide.select(
        *[c for c in kept if c != ts],
        moved.alias(ts),
        "sample",
        *[F.col("_values")[n].cast("double").alias(n) for n in signals],
    )


def reduce_samples(rows: DataFrame, ts: str, signals: dict[str, Column], mode: str = "mean") -> DataFrame:
    """One value per second and signal out of its array of samples."""
    kept = [c for c in rows.columns if c not in signals]
    values = [one_hz_value(a, mode).alias(n) for n, a in signals.items()]
    return rows.where(F.col(ts).isNotNull()).select(*kept, *values)
