"""Registry matching: typed registry, unique matches, anonymised exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.config import EXTRA_COLUMNS
from vitalspan.operators import matching, registry
from vitalspan.operators.skew import join_per_key
from vitalspan.sources import sinks, tables


@dataclass(frozen=True)
class MatchCounts:
    total_rows: int
    usable_rows: int
    matched_rows: int
    ambiguous_rows: int


def enriched_registry(registry_raw: DataFrame, neonatal_raw: DataFrame) -> DataFrame:
    return registry.enrich(registry.parse_registry(registry_raw), registry.parse_neonatal(neonatal_raw))


def matched_registry(people: DataFrame, dated_rows: DataFrame, unique_on: str = "registry") -> DataFrame:
    """The exported registry table: one row per uniquely matched registry row."""
    recordings = matching.recording_map(dated_rows, "BabyID", "PatientID", "ctg_date")
    single = matching.unique_matches(people, recordings, "PatientID", "birth_day", "BabyID", "ctg_date", unique_on)
    return single.select(*registry.REGISTRY_COLUMNS)


def matched_series(partitioned_rows: DataFrame, matched: DataFrame) -> DataFrame:
    """Signal rows of the matched subjects without person key and date."""
    keep = ["BabyID", "Timestamp", "FHR", "toco", *[c for c in EXTRA_COLUMNS if c in partitioned_rows.columns]]
    babies = matched.select("BabyID").distinct()
    return join_per_key(partitioned_rows.select(*keep), babies, "BabyID", ["Timestamp"], "left_semi").select(*keep)


def match_counts(registry_raw: DataFrame, people: DataFrame, dated_rows: DataFrame) -> MatchCounts:
    recordings = matching.recording_map(dated_rows, "BabyID", "PatientID", "ctg_date")
    found = matching.matches_per_row(people, recordings, "PatientID", "birth_day", "BabyID", "ctg_date")
    tally = found.agg(
        F.count_if(F.col("n_matches") == 1).alias("matched"), F.count_if(F.col("n_matches") > 1).alias("ambiguous")
    ).first()
    return MatchCounts(registry_raw.count(), people.count(), tally["matched"], tally["ambiguous"])


def run_matching(
    spark: SparkSession,
    registry_csv: str,
    neonatal_file: str,
    dated_path: str,
    partitioned_path: str,
    registry_out: str,
    series_out: str,
    unique_on: str = "registry",
) -> MatchCounts:
    registry_raw = tables.spread_scan(tables.read_text_csv(spark, registry_csv, ";"))
    people = enriched_registry(registry_raw, tables.spread_scan(tables.read_side_registry(spark, neonatal_file)))
    dated = spark.read.parquet(dated_path)
    matched = matched_registry(people, dated, unique_on)
    sinks.write_ordered_csv(matched, registry_out, ["BabyID"])
    exported = spark.read.option("header", True).csv(registry_out).select("BabyID")
    sinks.write_stage(matched_series(spark.read.parquet(partitioned_path), exported), series_out)
    return match_counts(registry_raw, people, dated)
