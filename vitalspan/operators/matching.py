"""Matching registry rows to recordings on person and birth day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.operators.skew import dealt


def recording_map(rows: DataFrame, subject: str, person: str, day: str) -> DataFrame:
    """Distinct (subject, person, recording day)."""
    return rows.select(subject, person, day).distinct()


def matches_per_day(
    registry: DataFrame, recordings: DataFrame, person: str, birth_day: str, subject: str, day: str
) -> DataFrame:
    """Registry rows with each day, birth day or the day before, on which the person was recorded.

    Recordings are counted per (person, day) first, so a busy day gives one row with its count.
    """
    per_day = dealt(recordings, person, day).groupBy(person, day).agg(
        F.count(F.lit(1)).alias("n_recordings"), F.min(subject).alias(subject)
    )
    wanted = F.explode(F.array(F.col(birth_day), F.date_sub(F.col(birth_day), 1)))
    return dealt(registry.withColumn(day, wanted), person, day).join(per_day, [person, day])


def matches_per_row(
    registry: DataFrame, recordings: DataFrame, person: str, birth_day: str, subject: str, day: str
) -> DataFrame:
    """Registry rows that match, with their number of matches and one matched subject.

    The recordings are first reduced to one row per (person, possible birth day), so
    the join never produces more than one row per registry row.
    """
    possible = recordings.withColumn(birth_day, F.explode(F.array(F.col(day), F.date_add(F.col(day), 1))))
    per_birth_day = dealt(possible, person, birth_day).groupBy(person, birth_day).agg(
        F.count(F.lit(1)).alias("n_matches"), F.min(subject).alias(subject), F.min(day).alias(day)
    )
    return dealt(registry, person, birth_day).join(per_birth_day, [person, birth_day])


def unique_matches(
    registry: DataFrame,
    recordings: DataFrame,
    person: str,
    birth_day: str,
    subject: str,
    day: str,
    unique_on: str = "registry",
) -> DataFrame:
    """Registry rows with exactly one recording.

    Two registry rows (twins) may keep the same subject; ``unique_on="subject"`` drops
    the subjects that more than one registry row claims.
    """
    found = matches_per_row(registry, recordings, person, birth_day, subject, day)
    single = found.where(F.col("n_matches") == 1).drop("n_matches")
    if unique_on == "registry":
        return single
    if unique_on != "subject":
        raise ValueError(f"unknown uniqueness rule: {unique_on}")
    # One pass: in a group of one row, first() is that row.
    kept = [c for c in single.columns if c != subject]
    claims = dealt(single.where(F.col(subject).isNotNull()), subject).groupBy(subject).agg(
        F.count(F.lit(1)).alias("_claims"), *[F.first(c).alias(c) for c in kept]
    )
    return claims.where(F.col("_claims") == 1).select(*single.columns)
