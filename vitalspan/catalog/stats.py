"""Queries on quantiles, steps and aggregate features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import DAY, as_double, query, six, table
from vitalspan.functions.dates import duration_seconds
from vitalspan.operators import features
from vitalspan.operators.quantiles import exact_quantiles

TOCO_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def two_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two signals; small readings count as zero signal."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        "user_id",
        "ts",
        F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")).alias("fhr"),
        F.get_json_object("props", "$.k").cast("double").alias("toco"),
    )


TWO_SIGNALS_SQL = f"""
src AS (SELECT event_id, user_id, ts, CASE WHEN value < 20 THEN 0.0 ELSE value END AS fhr, {TOCO_SQL} AS toco FROM events),
stepped AS (SELECT *, abs(fhr - lag(fhr) OVER w) AS fhr_step, abs(toco - lag(toco) OVER w) AS toco_step
            FROM src WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(
    "quantiles_cont",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS price_q10,
           round(quantile_cont(l_extendedprice, 0.5), 6) AS price_q50,
           round(quantile_cont(l_extendedprice, 0.9), 6) AS price_q90,
           round(quantile_cont(l_quantity, 0.5), 6) AS quantity_q50
    FROM lineitem GROUP BY 1""",
)
def quantiles_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    wanted = {
        "price_q10": ("l_extendedprice", 0.1),
        "price_q50": ("l_extendedprice", 0.5),
        "price_q90": ("l_extendedprice", 0.9),
        "quantity_q50": ("l_quantity", 0.5),
    }
    found = exact_quantiles(rows, ["l_returnflag"], wanted, spread_by=["l_orderkey", "l_linenumber"])
    return found.select("l_returnflag", *[six(F.col(c), c) for c in wanted])


@query("median_overall", "SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS price_median FROM orders")
def median_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_quantiles(table(spark, sf_dir, "orders"), [], {"price_median": ("o_totalprice", 0.5)})
    return found.select(six(F.col("price_median"), "price_median"))


@query(
    "abs_first_diff",
    f"WITH {TWO_SIGNALS_SQL} SELECT event_id, round(fhr_step, 6) AS fhr_step, round(toco_step, 6) AS toco_step FROM stepped",
)
def abs_first_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = two_signals(spark, sf_dir)
    stepped = features.absolute_steps(
        rows, "user_id", "ts", {"fhr_step": "fhr", "toco_step": "toco"}, DAY, tie=["event_id"]
    )
    return stepped.select("event_id", six(F.col("fhr_step"), "fhr_step"), six(F.col("toco_step"), "toco_step"))


FEATURE_SQL = f"""WITH {TWO_SIGNALS_SQL}
SELECT user_id, count(*) AS n_rows,
       round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000.0, 6) AS duration_seconds,
       round(avg(fhr), 6) AS fhr_mean, round(stddev_samp(fhr), 6) AS fhr_std, min(fhr) AS fhr_min, max(fhr) AS fhr_max,
       round(avg(CASE WHEN fhr = 0 THEN 1.0 ELSE 0.0 END), 6) AS fhr_zero_frac,
       round(avg(CASE WHEN fhr > 0 THEN fhr END), 6) AS fhr_nonzero_mean,
       round(stddev_samp(CASE WHEN fhr > 0 THEN fhr END), 6) AS fhr_nonzero_std,
       round(quantile_cont(fhr, 0.1), 6) AS fhr_q10, round(quantile_cont(fhr, 0.5), 6) AS fhr_q50,
       round(quantile_cont(fhr, 0.9), 6) AS fhr_q90,
       round(avg(toco), 6) AS toco_mean, round(stddev_samp(toco), 6) AS toco_std, min(toco) AS toco_min, max(toco) AS toco_max,
       round(quantile_cont(toco, 0.1), 6) AS toco_q10, round(quantile_cont(toco, 0.5), 6) AS toco_q50,
       round(quantile_cont(toco, 0.9), 6) AS toco_q90,
       round(avg(fhr_step), 6) AS fhr_abs_diff_mean, round(avg(toco_step), 6) AS toco_abs_diff_mean
FROM stepped GROUP BY user_id"""


@query("aggregate_features", FEATURE_SQL)
def aggregate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that a task can order, as the pipeline has them."""
    return _features(spark, sf_dir, True)


@query("aggregate_features_any_size", FEATURE_SQL)
def aggregate_features_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of any size, cut into cells and brackets."""
    return _features(spark, sf_dir, False)


def _features(spark: SparkSession, sf_dir: str, bounded: bool) -> DataFrame:
    found = features.aggregate_features(
        two_signals(spark, sf_dir), "user_id", "ts", "fhr", "toco", cell_seconds=DAY, tie=["event_id"], bounded=bounded
    )
    rounded = [six(F.col(c), c) for c in features.FEATURE_NAMES if c != "n_rows"]
    return found.select("user_id", "n_rows", *rounded)


@query(
    "grouped_counts",
    """SELECT event_type, count(*) AS n_rows, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_high,
           min(value) AS min_value, max(value) AS max_value, max(ts) FILTER (WHERE value > 100) AS last_high_ts
    FROM events GROUP BY 1""",
)
def grouped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("n_high"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max(F.when(F.col("value") > 100, F.col("ts"))).alias("last_high_ts"),
    )


@query(
    "epoch_duration",
    """SELECT user_id, round(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1000000.0, 6) AS duration_seconds
    FROM events GROUP BY 1""",
)
def epoch_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").groupBy("user_id").agg(
        duration_seconds(F.min("ts"), F.max("ts")).alias("duration_seconds")
    )
    return as_double(found, "duration_seconds").select("user_id", six(F.col("duration_seconds"), "duration_seconds"))
