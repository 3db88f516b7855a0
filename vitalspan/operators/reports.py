"""Cohort counts and checks on raw and final series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions.dates import duration_seconds, lenient_date
from vitalspan.functions.text import digits_only, person_key
from vitalspan.operators.cells import with_previous


def registry_people(registry: DataFrame, column: str = "personnummer_mor", name: str = "PatientID") -> DataFrame:
    """Distinct person keys of a registry; numbers with fewer than twelve digits are left out."""
    digits = registry.select(digits_only(F.col(column)).alias("_digits")).where(F.length("_digits") >= 12)
    return digits.select(person_key(F.col("_digits")).alias(name)).distinct()


def stage_counts(rows: DataFrame, stage: str, patient: str | None, subject: str | None) -> DataFrame:
    """Exact row, patient and subject counts of one stage."""

    def distinct(column: str | None, name: str):
        return (F.count_distinct(column) if column else F.lit(None).cast("bigint")).alias(name)

    counted = rows.agg(F.count(F.lit(1)).alias("n_rows"), distinct(patient, "n_patients"), distinct(subject, "n_subjects"))
    return counted.select(F.lit(stage).alias("stage"), "n_rows", "n_patients", "n_subjects")


def overlap(rows: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys that also occur in ``people``."""
    found = rows.select(key).distinct().join(people, key, "left_semi")
    return found.agg(F.count(F.lit(1)).alias("n_overlap"))


def conflicting_owners(rows: DataFrame, registration: str, patient: str) -> DataFrame:
    """Registrations that belong to more than one patient."""
    owned = rows.dropna(subset=[registration, patient]).groupBy(registration).agg(
        F.min(patient).alias("first_owner"),
        F.max(patient).alias("last_owner"),
        F.count_distinct(patient).alias("n_owners"),
    )
    return owned.where(F.col("n_owners") > 1)


def registrations_per_day(rows: DataFrame, patient: str, ts: str, registration: str) -> DataFrame:
    """Distinct registrations of each patient and day, with the day's count on every row."""
    distinct = (
        rows.select(patient, lenient_date(F.col(ts)).alias("day"), registration)
        .dropna(subset=["day", registration])
        .distinct()
    )
    counts = distinct.groupBy(patient, "day").agg(F.count(F.lit(1)).alias("n_registrations"))
    return distinct.join(counts, [patient, "day"])


def unexpected_row_counts(rows: DataFrame, subject: str, expected: int) -> DataFrame:
    counts = rows.groupBy(subject).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.where(F.col("n_rows") != expected)


def output_summary(rows: DataFrame, subject: str, ts: str, signals: Sequence[str]) -> DataFrame:
    """Row and subject counts, time range and missing ratio of each signal."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(subject).alias("n_subjects"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        *[
            F.avg(F.when(F.col(s).isNull() | F.isnan(F.col(s).cast("double")), 1.0).otherwise(0.0)).alias(
                f"{s}_missing_ratio"
            )
            for s in signals
        ],
    )


def modal_spacing(rows: DataFrame, subject: str, ts: str, cell_seconds: float = 3600) -> DataFrame:
    """Most frequent distance between consecutive rows; the shortest one on ties."""
    stepped = with_previous(rows, [subject], ts, {"_before": ts}, cell_seconds)
    gaps = stepped.select(subject, duration_seconds(F.col("_before"), F.col(ts)).alias("spacing_seconds"))
    tally = gaps.dropna().groupBy(subject, "spacing_seconds").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("spacing_seconds", F.struct("n", (-F.col("spacing_seconds")).alias("_short")))
    return tally.groupBy(subject).agg(best.alias("spacing_seconds"))


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.count_distinct(column).alias("n_distinct"))


def worst_sources(failures: DataFrame, n: int, source: str = "source") -> DataFrame:
    """The sources with most failures, names in order on ties."""
    counts = failures.groupBy(source).agg(F.count(F.lit(1)).alias("n_failures"))
    return counts.orderBy(F.col("n_failures").desc(), source).limit(n)
