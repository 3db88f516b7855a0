"""Writers: stage outputs, partitioned outputs, restart-safe outputs, CSV exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def write_stage(df: DataFrame, path: str) -> None:
    """Replace a stage output; Spark's commit keeps half-written output invisible."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_partitioned(
    df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str], files_per_value: int = 8, max_rows: int = 20_000_000
) -> None:
    """Partitioned parquet, sorted inside each file.

    The rows of one partition value are spread over ``files_per_value`` tasks by a hash
    of the first sort column, so a very large value neither lands in one task nor one file.
    """
    spread = F.pmod(F.xxhash64(sort[0]), F.lit(files_per_value))
    (
        df.withColumn("_spread", spread)
        .repartition(*by, "_spread")
        .sortWithinPartitions(*by, *sort)
        .drop("_spread")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy(*by)
        .parquet(path)
    )


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("compression", "zstd").parquet(path)


def write_ordered_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Header CSV in global order; one file per sorted range, names in range order."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
