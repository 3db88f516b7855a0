"""Cohort report: exact counts of every stored stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalspan.functions.keys import stable_order
from vitalspan.operators import reports, sessions
from vitalspan.sources import tables

REPORT_SCHEMA = T.StructType(
    [T.StructField("stage", T.StringType())]
    + [
        T.StructField(n, T.LongType())
        for n in ("n_rows", "patients", "babies", "pregnancies", "registry_overlap_patients", "files")
    ]
    + [T.StructField("size_mb", T.DoubleType())]
)


def stage_line(
    rows: DataFrame, people: DataFrame, gap_seconds: float, episode_gap_seconds: float
) -> tuple[int, int | None, int | None, int | None, int | None]:
    """Rows, patients, babies, pregnancies and registry overlap of one stage.

    Before subjects exist, pregnancies are counted from the gaps between sessions.
    """
    has = set(rows.columns)
    patient = "PatientID" if "PatientID" in has else None
    subject = "BabyID" if "BabyID" in has else None
    counts = reports.stage_counts(rows, "", patient, subject).first()
    pregnancies = counts["n_subjects"]
    if subject is None and patient and "Timestamp" in has:
        episodes = sessions.count_episodes(rows, "PatientID", "Timestamp", gap_seconds, episode_gap_seconds)
        pregnancies = episodes.first()["n_episodes"]
    overlap = reports.overlap(rows, people, "PatientID").first()["n_overlap"] if patient else None
    return counts["n_rows"], counts["n_patients"], counts["n_subjects"], pregnancies, overlap


def cohort_report(
    spark: SparkSession,
    registry_csv: str,
    stages: Mapping[str, str],
    gap_minutes: float = 5,
    episode_gap_days: float = 200,
) -> DataFrame:
    """One line per stage; a stage without files has NULL counts and zero files."""
    people = reports.registry_people(tables.read_text_csv(spark, registry_csv, ";"))
    lines = []
    for stage, path in stages.items():
        files, size = tables.storage_size(spark, path)
        if files == 0:
            lines.append((stage, None, None, None, None, None, 0, 0.0))
            continue
        counts = stage_line(spark.read.parquet(path), people, gap_minutes * 60, episode_gap_days * 86_400)
        lines.append((stage, *counts, files, round(size / 2**20, 1)))
    return spark.createDataFrame(lines, REPORT_SCHEMA)


def inspect_raw(rows: DataFrame, patient: str = "PatientID", registration: str = "RegistrationID") -> DataFrame:
    """Row count, distinct patients and registrations, registrations with several patients."""
    conflicts = reports.conflicting_owners(rows, registration, patient).agg(F.count(F.lit(1)).alias("n_conflicts"))
    counts = reports.stage_counts(rows, "raw", patient, registration)
    named = counts.select("n_rows", "n_patients", F.col("n_subjects").alias("n_registrations"))
    return named.withColumn("n_conflicts", conflicts.scalar())


def trace(series: DataFrame, subject: str, minutes: float = 60) -> DataFrame:
    """Last part of one subject's series in time order."""
    rows = series.where(F.col("BabyID") == subject)
    last = rows.agg(F.max("Timestamp").alias("last_ts"))
    bound = last.scalar() - F.make_dt_interval(mins=F.lit(int(minutes)))
    return rows.where(F.col("Timestamp") >= bound).select("Timestamp", "FHR", "toco").orderBy("Timestamp")


def pick_subject(series: DataFrame, seed: int, registry: DataFrame | None = None, apgar5: int | None = None) -> DataFrame:
    """One subject at random (repeatable per seed), optionally with a given five-minute score."""
    babies = series.select("BabyID").distinct()
    if apgar5 is not None:
        if registry is None:
            raise ValueError("a score needs the registry table")
        scored = registry.where(F.col("apgar5").cast("int") == apgar5).select("BabyID")
        babies = babies.join(scored, "BabyID", "left_semi")
    return babies.orderBy(stable_order(F.col("BabyID"), seed)).limit(1)
