"""Joins of a large side with a table that has one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEWEST_SALTS, MOST_SALTS, PARTITIONS_PER_SALT = 4, 256, 64
TRACKED_KEYS = 256
LEAST_HOT_SHARE = 1 / 64  # so that no more than about half of the tracked keys are warm


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salt_count(df: DataFrame) -> int:
    """Salts that fit the session: one per 64 shuffle partitions, within 4 and 256."""
    return max(FEWEST_SALTS, min(MOST_SALTS, _partitions(df) // PARTITIONS_PER_SALT))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by a hash of the keys over all shuffle partitions of the session.

    Adaptive execution merges shuffle partitions by their compressed bytes.  Narrow rows with
    regular keys compress so well that a merged partition fills gigabytes once its rows stand
    in a sort buffer or a hash table; partitions of an explicit number are never merged.
    """
    return rows.repartition(_partitions(rows), *keys)


def _name(key: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in key])


def hot_keys(names: DataFrame) -> DataFrame:
    """One row with the hashes of hot keys: those with more rows than a shuffle partition should hold.

    A mergeable heavy-hitter sketch counts them on the map side, with an error far below half
    of the limit.  ``warm`` reaches down to half of it, so whatever one reading of the sketch
    calls hot is warm in any other.  A key that is rated too high is spread without need,
    nothing else.
    """
    share = max(1 / _partitions(names), LEAST_HOT_SHARE)
    counted = names.agg(F.expr(f"approx_top_k(_name, {TRACKED_KEYS})").alias("top"), F.count(F.lit(1)).alias("n"))

    def above(limit: float) -> Column:
        kept = F.filter("top", lambda t: t["count"] > F.col("n") * F.lit(limit))
        return F.transform(kept, lambda t: t["item"])

    return counted.select(above(share).alias("hot"), above(share / 2).alias("warm"))


def join_per_key(
    rows: DataFrame,
    per_key: DataFrame,
    key: str | Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Join rows to a one-row-per-key table; only keys that are measured to be hot are salted.

    The salt of a row with a hot key is a hash of ``spread_by``, so it is the same when a task
    is run again; the hot keys' rows of the other side are repeated once per salt.  All other
    keys take a plain equi-join.  Spark still broadcasts the per-key side by itself when its
    measured size is below the threshold, and still splits a partition that stays too large.
    """
    key = [key] if isinstance(key, str) else list(key)
    salts = salts or salt_count(rows)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", F.when(_among(rows, key, "hot"), salt).otherwise(0))
    return salted.join(_repeated(rows, per_key, key, salts), [*key, "_salt"], how).drop("_salt")


def _among(rows: DataFrame, key: Sequence[str], which: str) -> Column:
    found = hot_keys(rows.select(_name(key).alias("_name"))).select(F.struct("hot", "warm").alias("found"))
    return F.array_contains(found.scalar()[which], _name(key))


def _repeated(rows: DataFrame, per_key: DataFrame, key: Sequence[str], salts: int) -> DataFrame:
    """The per-key side with the keys that are warm in ``rows`` once per salt, all others once."""
    kinds = dict(rows.dtypes)
    same = per_key.withColumns({k: F.col(k).cast(kinds[k]) for k in key})
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return same.withColumn("_salt", F.explode(F.when(_among(rows, key, "warm"), every).otherwise(F.array(F.lit(0)))))


def with_single_row(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a table of exactly one row (a scalar subquery, no join)."""
    packed = single.select(F.struct("*").alias("_single")).scalar()
    return rows.withColumn("_single", packed).select(*rows.columns, "_single.*")
