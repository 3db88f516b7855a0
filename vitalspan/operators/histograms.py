"""Exact statistics of bounded groups from mergeable maps of value to count.

Each task counts the distinct values of a group, the maps are merged after one exchange, and
quantiles, means and shares are read from them in the same aggregation.  The state of a group is
its number of distinct values, so the caller chooses this for groups bounded by the sensor's
resolution or by the length of a window; ``quantiles.exact_quantiles`` takes groups of any size.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspan.functions.signal import real_number


def quantile_columns(wanted: Mapping[str, tuple[str, float]]) -> list[Column]:
    """Aggregates for ``wanted`` (name -> value column, probability), linearly interpolated.

    Quantiles of one column share one map.  Null and NaN have no part.
    """
    probabilities: dict[str, list[float]] = {}
    for column, p in wanted.values():
        probabilities.setdefault(column, [])
        if p not in probabilities[column]:
            probabilities[column].append(p)
    maps = {c: F.percentile(real_number(F.col(c).cast("double")), ps) for c, ps in probabilities.items()}
    return [F.get(maps[c], F.lit(probabilities[c].index(p))).alias(name) for name, (c, p) in wanted.items()]
