"""Sessions of a growing series: the batch session rule on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import plus_seconds


def stream_sessions(rows: DataFrame, key: str, ts: str, gap_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """Closed sessions of a streaming series; works on a batch as well.

    A session is emitted once the watermark has passed its end plus the gap.  A gap of
    exactly ``gap_seconds`` keeps a session open, as in the batch rule.
    """
    timed = rows.dropna(subset=[key, ts]).withColumn(ts, F.col(ts).cast("timestamp"))
    closed = timed.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("_w"))
    return closed.agg(F.count(F.lit(1)).alias("n_rows")).select(
        key,
        F.col("_w.start").cast("timestamp_ntz").alias("session_start"),
        plus_seconds(F.col("_w.end").cast("timestamp_ntz"), -gap_seconds).alias("session_end"),
        "n_rows",
    )
