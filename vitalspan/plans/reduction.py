"""Cohort reduction: time filter, derived signals, closing windows, vote, quality, anchor date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspan.config import EXTRA_COLUMNS, ReductionSettings
from vitalspan.functions.keys import salted_key
from vitalspan.functions.signal import mean_positive, real_number, with_toco_level
from vitalspan.functions.text import suffix_bucket
from vitalspan.operators import dedup, quality, sessions
from vitalspan.sources import sinks, tables

INTEGRAL_TYPES = {"tinyint", "smallint", "int", "bigint"}


def time_filter(raw: DataFrame, cutoff: str, ts: str = "Timestamp") -> DataFrame:
    """Rows at or after midnight of the cutoff date."""
    return raw.where(F.col(ts) >= F.lit(cutoff).cast("timestamp_ntz"))


def derive_signals(raw: DataFrame) -> DataFrame:
    """Per-second heart rate and contraction level plus the extra columns (NULL if absent)."""
    samples = [f"Hr1_{i}" for i in range(4)]
    kinds = dict(raw.dtypes)
    integral = all(kinds[c] in INTEGRAL_TYPES for c in samples)
    present = [c for c in raw.columns if c not in ("RegistrationID", *EXTRA_COLUMNS)]
    wide = tables.with_columns_or_null(raw, ["RegistrationID", *EXTRA_COLUMNS, *present])
    if "Toco_Values" in kinds:
        wide = with_toco_level(wide, "Toco_Values", "toco")
    else:
        wide = wide.withColumn("toco", F.lit(0.0).cast("float"))
    return wide.select(
        "Timestamp",
        "PatientID",
        "RegistrationID",
        mean_positive([F.col(c) for c in samples], integral).alias("FHR"),
        "toco",
        *EXTRA_COLUMNS,
    )


def closing_session_rows(
    series: DataFrame,
    settings: ReductionSettings,
    key: str = "PatientID",
    ts: str = "Timestamp",
    value: str = "FHR",
    subject: str = "BabyID",
    bucket: tuple[int, int] | None = None,
) -> DataFrame:
    """Rows of the closing window of every episode, under a pseudonymous subject key.

    ``bucket`` is (bucket count, bucket index) for a run on part of the patients.
    """
    if bucket is not None:
        series = series.where(suffix_bucket(F.col(key), bucket[0]) == bucket[1])
    windows = sessions.closing_windows(
        series, key, ts, value, settings.gap_seconds, settings.episode_gap_seconds, settings.window_seconds
    ).select(
        key,
        "window_start",
        "window_end",
        salted_key(settings.salt, F.col(key), F.col("session_end")).alias(subject),
    )
    kept = sessions.rows_in_windows(
        series, windows, key, ts, "window_start", "window_end", max(settings.window_seconds, 1.0)
    )
    return kept.select(subject, *series.columns)


def remove_duplicates(rows: DataFrame, max_rate: float) -> DataFrame:
    """Drop noisy subjects, then vote one row per second."""
    kept = dedup.drop_noisy_keys(rows, "BabyID", "Timestamp", max_rate)
    voted = dedup.vote_per_instant(kept, ["BabyID", "Timestamp"], "FHR", "toco", EXTRA_COLUMNS, first=["PatientID"])
    return voted.select("BabyID", "PatientID", "Timestamp", "FHR", "toco", *EXTRA_COLUMNS)


def keep_informative(rows: DataFrame, minimum: int) -> DataFrame:
    return quality.keep_informative(rows, "BabyID", "Timestamp", real_number(F.col("FHR")) > 0, minimum)


def add_anchor_date(rows: DataFrame) -> DataFrame:
    return quality.with_anchor_date(rows, "BabyID", "Timestamp", "ctg_date")


def reduce_series(series: DataFrame, settings: ReductionSettings) -> DataFrame:
    """Derived series to dated, voted, quality-filtered rows in one job."""
    return reduce_windows(closing_session_rows(series, settings), settings)


def reduce_windows(rows: DataFrame, settings: ReductionSettings) -> DataFrame:
    """Closing windows to dated, voted, quality-filtered rows.

    A subject holds at most one window of seconds once voted, so the per-subject
    filters are windows over a bounded group and share a single shuffle.
    """
    rows = rows.dropna(subset=["BabyID"])
    n = F.count(F.lit(1)).alias("_copies")
    voted = rows.groupBy("BabyID", "Timestamp").agg(
        F.min("PatientID").alias("PatientID"),
        dedup.median_positive("FHR").alias("FHR"),
        dedup.median_plausible("toco").alias("toco"),
        *[dedup.most_common(c).alias(c) for c in EXTRA_COLUMNS],
        n,
    )
    per_subject = Window.partitionBy("BabyID")

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).over(per_subject)

    seconds = F.count(F.lit(1)).over(per_subject)
    measured = voted.select(
        "*",
        (share(F.col("_copies") > 1) * 1.0 / seconds).alias("_dup_rate"),
        share(F.col("FHR") > 0).alias("_positive"),
        F.max("Timestamp").over(per_subject).cast("date").alias("ctg_date"),
    )
    kept = measured.where(
        (F.col("_dup_rate") <= settings.max_duplicate_rate) & (F.col("_positive") >= settings.min_positive_seconds)
    )
    return kept.select("BabyID", "PatientID", "Timestamp", "FHR", "toco", *EXTRA_COLUMNS, "ctg_date")


class StagedReduction:
    """The same reduction with one parquet output per stage below a root folder."""

    FOLDERS = {
        "stage1": "stage_1_timefilter",
        "stage2": "stage_2_columnfilter",
        "stage3": "stage_3_sessionfilter",
        "stage4": "stage_4_duplicatefilter",
        "stage5": "stage_5_qualityfilter",
        "stage5_5": "stage_5_5_sorted",
        "stage6": "stage_6_partitioned",
    }

    def __init__(self, spark: SparkSession, root: str, settings: ReductionSettings) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.settings = settings

    def path(self, stage: str) -> str:
        return f"{self.root}/{self.FOLDERS[stage]}"

    def read(self, stage: str, override: str | None = None) -> DataFrame:
        return self.spark.read.parquet(override or self.path(stage))

    def stage1(self, raw_dir: str, output: str | None = None) -> None:
        raw = tables.read_unified_parquet(self.spark, tables.parquet_files(self.spark, raw_dir))
        sinks.write_stage(time_filter(raw, self.settings.cutoff), output or self.path("stage1"))

    def stage2(self, source: str | None = None, output: str | None = None) -> None:
        sinks.write_stage(derive_signals(self.read("stage1", source)), output or self.path("stage2"))

    def stage3(self, source: str | None = None, output: str | None = None, bucket: tuple[int, int] | None = None) -> None:
        rows = closing_session_rows(self.read("stage2", source), self.settings, bucket=bucket)
        sinks.write_stage(rows, output or self.path("stage3"))

    def stage4(self, source: str | None = None, output: str | None = None) -> None:
        rows = remove_duplicates(self.read("stage3", source), self.settings.max_duplicate_rate)
        sinks.write_stage(rows, output or self.path("stage4"))

    def stage5(self, source: str | None = None, output: str | None = None) -> None:
        rows = keep_informative(self.read("stage4", source), self.settings.min_positive_seconds)
        sinks.write_stage(rows, output or self.path("stage5"))

    def stage5_5(self, source: str | None = None, output: str | None = None) -> None:
        dated = add_anchor_date(self.read("stage5", source))
        sinks.write_stage(dated.orderBy("ctg_date", "BabyID", "Timestamp"), output or self.path("stage5_5"))

    def stage6(self, source: str | None = None, output: str | None = None) -> None:
        rows = self.read("stage5_5", source)
        if "ctg_date" not in rows.columns:
            rows = add_anchor_date(rows)
        sinks.write_partitioned(rows, output or self.path("stage6"), by=["ctg_date"], sort=["BabyID", "Timestamp"])

    def run_all(self, raw_dir: str) -> None:
        self.stage1(raw_dir)
        for stage in ("stage2", "stage3", "stage4", "stage5", "stage5_5", "stage6"):
            getattr(self, stage)()
