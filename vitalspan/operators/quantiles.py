"""Exact interpolated quantiles per group without holding a group in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.operators.skew import join_per_key, with_single_row

ACCURACY = 10_000
# Brackets around a probability, from narrow to wide; a group takes the narrowest that is
# some ranks wide for it, and its whole range where none is.
MARGINS = [0.0005, 0.005, 0.05]
LEAST_RANKS = 4


def _clamped(p: float) -> float:
    return min(1.0, max(0.0, p))


def _brackets(wanted: Mapping[str, tuple[str, float]], column: str) -> list[float]:
    """Probabilities just below and above every wanted quantile of a column."""
    sides = [side * m for m in MARGINS for side in (-1, 1)]
    return sorted({_clamped(p + side) for c, p in wanted.values() if c == column for side in sides})


def exact_quantiles(
    rows: DataFrame, group: Sequence[str], wanted: Mapping[str, tuple[str, float]], spread_by: Sequence[str] | None = None
) -> DataFrame:
    """One row per group with a column per wanted quantile, linearly interpolated.

    ``wanted`` maps an output name to (value column, probability).  A mergeable sketch
    with a guaranteed rank error brackets each quantile, for groups of any size alike; values below the bracket are
    only counted and values inside it are counted per distinct value, so the exact
    order statistics are taken from a sliver of each group.  A bracket that misses its
    rank would break the sketch's guarantee and fails the query.
    """
    names = list(wanted)
    keys = list(group) or ["_all"]
    columns = sorted({c for c, _ in wanted.values()})
    base = rows.select(
        *[F.col(k) for k in group],
        *([] if group else [F.lit(0).alias("_all")]),
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns],
        *[F.col(c).alias(f"_spread_{i}") for i, c in enumerate(spread_by or [])],
    ).dropna(subset=keys)
    spread = [f"_spread_{i}" for i in range(len(spread_by or []))] or columns

    sketch = base.groupBy(*keys).agg(
        *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.min(c).alias(f"_min_{c}") for c in columns],
        *[F.max(c).alias(f"_max_{c}") for c in columns],
        *[F.percentile_approx(c, _brackets(wanted, c), ACCURACY).alias(f"_near_{c}") for c in columns],
    )
    if group:
        located = join_per_key(base, sketch, keys, spread_by=spread)
    else:
        located = with_single_row(base, sketch.drop("_all"))

    def item(which: int, column: str, value: Column) -> Column:
        return F.struct(F.lit(which).alias("which"), F.col(f"_n_{column}").alias("n"), value.alias("value"))

    def bracketed(index: int, name: str) -> Column:
        column, p = wanted[name]
        value, near, probes = F.col(column), F.col(f"_near_{column}"), _brackets(wanted, column)
        n, low, high = F.col(f"_n_{column}"), F.col(f"_min_{column}"), F.col(f"_max_{column}")
        for m in reversed(MARGINS):
            wide = n * F.lit(m) >= LEAST_RANKS
            if p > m:
                low = F.when(wide, near[probes.index(_clamped(p - m))]).otherwise(low)
            if p < 1 - m:
                high = F.when(wide, near[probes.index(_clamped(p + m))]).otherwise(high)
        return F.when(value <= high, item(index, column, F.when(value >= low, value)))

    found = [bracketed(i, n) for i, n in enumerate(names)]
    items = F.filter(F.array(*found), lambda x: x.isNotNull())
    exploded = located.select(*keys, F.explode(items).alias("item")).select(*keys, "item.*")
    counted = exploded.groupBy(*keys, "which", "n", "value").agg(F.count(F.lit(1)).alias("_times"))
    upward = (
        Window.partitionBy(*keys, "which")
        .orderBy(F.col("value").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counted.withColumn("_up_to", F.sum("_times").over(upward))

    def order_statistics(index: int, name: str) -> list[Column]:
        column, p = wanted[name]
        own = F.col("which") == index
        rank = F.lit(p) * (F.col("n") - 1)
        at = F.floor(rank)
        next_at = F.least(at + 1, F.col("n") - 1)
        return [
            F.min(F.when(own & (F.col("_up_to") > at), F.col("value"))).alias(f"_low_{name}"),
            F.min(F.when(own & (F.col("_up_to") > next_at), F.col("value"))).alias(f"_high_{name}"),
            F.max(F.when(own, rank)).alias(f"_rank_{name}"),
            F.max(F.when(own & F.col("value").isNull(), F.col("_up_to"))).alias(f"_under_{name}"),
        ]

    picked = ranked.groupBy(*keys).agg(*[c for i, n in enumerate(names) for c in order_statistics(i, n)])

    def interpolated(name: str) -> Column:
        low, high, rank = F.col(f"_low_{name}"), F.col(f"_high_{name}"), F.col(f"_rank_{name}")
        at = F.floor(rank)
        outside = (F.coalesce(F.col(f"_under_{name}"), F.lit(0)) > at) | (rank.isNotNull() & high.isNull())
        failure = F.raise_error(F.lit(f"bracket of {name} misses its rank")).cast("double")
        return F.when(outside, failure).otherwise(low + (high - low) * (rank - at)).alias(name)

    return picked.select(*group, *[interpolated(n) for n in names])
