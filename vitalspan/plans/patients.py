"""Patient-by-patient processing as one job: load around birth, denoise, number, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalspan.functions.signal import toco_samples
from vitalspan.functions.text import comma_int_truncated, dashed_person_id, suffix_bucket, text_date
from vitalspan.operators import denoise, expand
from vitalspan.operators.cells import position_in_group
from vitalspan.plans.reduction import time_filter
from vitalspan.sources import sinks, tables

IDS_PER_BUCKET = 100_000
RAW_SAMPLES = [f"Hr1_{i}" for i in range(4)]


def numbered_rows(rows: DataFrame, name: str = "row_number") -> DataFrame:
    """Rows with their 1-based position in the source files.

    Positions inside each input partition are shifted by the row counts of the
    partitions before it.
    """
    marked = rows.withColumn("_mark", F.monotonically_increasing_id())
    split = marked.withColumns(
        {"_part": F.shiftright("_mark", 33), "_within": F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = split.groupBy("_part").agg(F.max("_within").alias("_last"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_offset"))
    joined = split.join(offsets, "_part")
    return joined.select(*rows.columns, (F.col("_offset") + F.col("_within") + 1).alias(name))


def patient_list(registry: DataFrame, start: int = 1, count: int | None = None) -> DataFrame:
    """A 1-based slice of the registry: row number, person, birth day, five-minute score."""
    if start < 1:
        raise ValueError("rows are numbered from 1")
    numbered = numbered_rows(registry.select("personnummer_mor", "forlossningsdatum_fv1", "apgar_5_min"))
    place = F.col("row_number")
    sliced = numbered.where(place >= start)
    if count is not None:
        sliced = sliced.where(place < start + count)
    return sliced.select(
        "row_number",
        dashed_person_id(F.trim("personnummer_mor")).alias("PatientID"),
        text_date(F.col("forlossningsdatum_fv1")).alias("birth_day"),
        comma_int_truncated(F.col("apgar_5_min")).alias("apgar5"),
    )


def birth_window(series: DataFrame, patients: DataFrame, date: str = "ctg_date") -> DataFrame:
    """Series rows of the birth day and the day before; all rows when the birth day is unknown.

    With a date-partitioned series the join on the date column prunes partitions.
    """
    if date not in series.columns:
        series = series.withColumn(date, F.col("Timestamp").cast("date"))
    known = patients.where(F.col("birth_day").isNotNull())
    days = known.withColumn(date, F.explode(F.array("birth_day", F.date_sub("birth_day", 1))))
    dated = series.join(days, ["PatientID", date])
    unknown = patients.where(F.col("birth_day").isNull())
    return dated.unionByName(series.join(unknown, "PatientID"), allowMissingColumns=True)


def signal_series(raw: DataFrame, sample_rate_hz: int = 4, mode: str = "mean") -> DataFrame:
    """Raw seconds as a 4 Hz series, or reduced to 1 Hz."""
    signals = {
        "FHR": F.array(*[F.col(c).cast("double") for c in RAW_SAMPLES]),
        "toco": toco_samples(F.col("Toco_Values")),
    }
    wide = raw.withColumns(signals).drop(*RAW_SAMPLES, "Toco_Values")
    arrays = {n: F.col(n) for n in signals}
    if sample_rate_hz == 1:
        return expand.reduce_samples(wide, "Timestamp", arrays, mode)
    if sample_rate_hz != 4:
        raise ValueError("the sample rate is 1 or 4")
    return expand.expand_samples(wide, "Timestamp", arrays).drop("sample")


def clean_patients(
    raw: DataFrame, patients: DataFrame, sample_rate_hz: int = 1, mode: str = "mean", min_share: float = 0.5
) -> DataFrame:
    """Denoised grid of every patient that has a score, a series and enough usable points."""
    scored = patients.where(F.col("apgar5").isNotNull() & (F.length("PatientID") > 0))
    loaded = birth_window(raw, scored).select("row_number", "Timestamp", *RAW_SAMPLES, "Toco_Values")
    series = signal_series(loaded, sample_rate_hz, mode)
    return denoise.denoise(
        series,
        "row_number",
        "Timestamp",
        "FHR",
        ["toco"],
        step_seconds=1.0 / sample_rate_hz,
        points=3600 * sample_rate_hz,
        min_share=min_share,
    )


def numbered_subjects(cleaned: DataFrame, first_id: int = 1) -> DataFrame:
    """Consecutive subject ids in registry row order, from ``first_id`` on."""
    found = cleaned.select("row_number").distinct()
    bucket = F.floor(F.col("row_number") / IDS_PER_BUCKET)
    placed = position_in_group(found, [], bucket, [F.col("row_number")], "_nth")
    return placed.select("row_number", (F.col("_nth") + (first_id - 1)).alias("BabyID"))


def process_patients(
    spark: SparkSession,
    registry_csv: str,
    raw: DataFrame,
    output: str,
    start: int = 1,
    count: int | None = None,
    sample_rate_hz: int = 1,
    mode: str = "mean",
    min_share: float = 0.5,
) -> None:
    """Append cleaned series and their metadata; ids continue after the stored ones."""
    patients = patient_list(tables.read_any_csv(spark, registry_csv), start, count)
    meta_path, series_path, work = (f"{output}/{n}" for n in ("metadata", "series", f"work_{start}"))
    sinks.write_stage(clean_patients(raw, patients, sample_rate_hz, mode, min_share), work)
    cleaned = spark.read.parquet(work)
    first = 1
    if tables.path_exists(spark, meta_path):
        first = (spark.read.parquet(meta_path).agg(F.max("BabyID").alias("m")).first()["m"] or 0) + 1
    ids = numbered_subjects(cleaned, first)
    sinks.append_rows(cleaned.join(ids, "row_number").select("BabyID", "Timestamp", "FHR", "toco"), series_path)
    metadata = ids.join(patients, "row_number").select("BabyID", "birth_day", "apgar5")
    sinks.append_rows(metadata, meta_path)


def partition_by_day(raw: DataFrame, output: str, cutoff: str, columns: list[str], buckets: int = 256) -> None:
    """Rows from the cutoff on, partitioned by date and patient bucket (-1 without one)."""
    rows = time_filter(raw, cutoff).select(
        *columns,
        F.col("Timestamp").cast("date").alias("ctg_date"),
        suffix_bucket(F.col("PatientID"), buckets).cast("smallint").alias("patient_bucket"),
    )
    sinks.write_partitioned(rows, output, ["ctg_date", "patient_bucket"], ["PatientID", "Timestamp"], files_per_value=1)
