"""Ordered operators that never put one whole key into one task.

A key is cut into cells (fixed time ranges, or value ranges).  Ordered work runs
inside a (key, cell) group; only one summary row per cell takes part in the window
over the whole key, so a key that holds a third of all rows is still spread over
many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.dates import time_cell

CELL = "_cell"


def with_cell(rows: DataFrame, ts: str, width_seconds: float, name: str = CELL) -> DataFrame:
    return rows.withColumn(name, time_cell(F.col(ts), width_seconds))


def with_previous(
    rows: DataFrame,
    key: Sequence[str],
    ts: str,
    columns: Mapping[str, str],
    cell_seconds: float,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add, per key in time order, the previous row's value of each column.

    ``columns`` maps a new column name to the column it is taken from.  The value
    for the first row of a cell is carried over from the last row of the cell before.
    """
    key = list(key)
    order = [ts, *tie]
    cut = with_cell(rows.dropna(subset=[*key, ts]), ts, cell_seconds)
    payload = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    inside = Window.partitionBy(*key, CELL).orderBy(*order)
    local = cut.withColumn("_before", F.lag(payload).over(inside)).withColumn("_nth", F.row_number().over(inside))
    last = cut.groupBy(*key, CELL).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*key).orderBy(CELL)
    carried = last.select(*key, CELL, F.lag("_last").over(across).alias("_carried"))
    joined = local.join(carried, [*key, CELL], "left")
    previous = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before"))
    out = joined.select(*rows.columns, previous.alias("_previous"))
    return out.select(*rows.columns, *[F.col("_previous")[new].alias(new) for new in columns])


def running_totals(
    rows: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    totals: Mapping[str, Column],
    descending_buckets: bool = False,
) -> DataFrame:
    """Inclusive running sums per group in ``order``.

    ``bucket`` must be monotone in ``order`` and take a bounded number of values;
    the order inside a bucket must be total.
    """
    group = list(group) or ["_all"]
    base = rows if group != ["_all"] else rows.withColumn("_all", F.lit(0))
    base = base.withColumn("_bucket", bucket)
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = base.select("*", *[F.sum(c).over(inside).alias(f"_in_{name}") for name, c in totals.items()])
    summary = base.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in totals.items()])
    bucket_order = F.col("_bucket").desc() if descending_buckets else F.col("_bucket").asc()
    before = Window.partitionBy(*group).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select(
        *group,
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_off_{name}") for name in totals],
    )
    joined = local.join(offsets, [*group, "_bucket"])
    return joined.select(
        *rows.columns, *[(F.col(f"_off_{name}") + F.col(f"_in_{name}")).alias(name) for name in totals]
    )


def position_in_group(
    rows: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Global 1-based position of each row in its group, ranked bucket by bucket."""
    return running_totals(rows, group, bucket, order, {name: F.lit(1).cast("bigint")})
