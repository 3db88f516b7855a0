"""Queries on raw samples and on the cleaning steps of the regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import DAY, HOUR, query, six, table
from vitalspan.functions import signal
from vitalspan.operators import denoise, expand

# Four whole-number samples per order line, some zero, negative or missing.
SAMPLES = [
    "CAST(l_quantity AS INT)",
    "CAST(l_linenumber * 20 - 30 AS INT)",
    "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 200 AS INT) END",
    "CAST(l_partkey % 3 - 1 AS INT)",
]
SAMPLES_SQL = "samples AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, " + ", ".join(
    f"{e} AS s{i}" for i, e in enumerate(SAMPLES)
) + " FROM lineitem)"


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", *[f"{e} AS s{i}" for i, e in enumerate(SAMPLES)]
    )


@query(
    "mean_positive_samples",
    f"""WITH {SAMPLES_SQL}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, [x FOR x IN [s0, s1, s2, s3] IF x > 0] AS v,
        [x FOR x IN [s0, CASE WHEN l_linenumber = 1 THEN NULL ELSE s1 END, s2, s3] IF x > 0] AS d FROM samples)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN len(v) > 0 THEN list_sum(v) // len(v) ELSE 0 END AS DOUBLE) AS rate,
        round(CAST(CAST(CASE WHEN len(d) > 0 THEN list_sum(d) / len(d) ELSE 0 END AS FLOAT) AS DOUBLE), 3) AS real_rate FROM p""",
)
def mean_positive_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer samples, and real ones of which some are NaN."""
    samples = [F.col(f"s{i}") for i in range(4)]
    rate = signal.mean_positive(samples).cast("double")
    real = [s.cast("double") for s in samples]
    real[1] = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(real[1])
    mean = signal.mean_positive(real, integral=False).cast("double")
    return line_samples(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", rate.alias("rate"), F.round(mean, 3).alias("real_rate")
    )


# Two hex digits per byte; both engines turn them into base64 text.
BYTES = ["l_quantity * 3", "l_linenumber * 16", "l_suppkey % 120", "l_partkey % 2 * 120"]
HEX = " || ".join(f"lpad(hex(CAST({b} AS BIGINT)), 2, '0')" for b in BYTES)
TEXT64 = f"CASE l_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '*' || base64(unhex({HEX})) WHEN 3 THEN 'abc' ELSE base64(unhex({HEX})) END"
BYTES_SQL = f"""
raw AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_orderkey % 6 IN (2, 4, 5)
        THEN [{', '.join(f'CAST({b} AS BIGINT)' for b in BYTES)}] ELSE [] END AS v FROM lineitem),
good AS (SELECT *, [x FOR x IN v IF x BETWEEN 1 AND 99] AS g FROM raw)"""


@query(
    "toco_level",
    f"""WITH {BYTES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(CAST(
        CASE WHEN len(g) > 0 THEN list_avg(g) WHEN len(v) > 0 THEN list_avg(v) ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS toco FROM good""",
)
def toco_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", f"{TEXT64} AS text64"
    )
    levels = signal.with_toco_level(rows, "text64", "toco")
    return levels.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("toco").cast("double"), 4).alias("toco")
    )


@query(
    "four_hz_expand",
    f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, CAST(i AS INTEGER) AS sample,
        l_shipdate + to_milliseconds(250 * i) AS moment,
        CAST([s0, s1, s2, s3][i + 1] AS DOUBLE) AS rate FROM samples CROSS JOIN range(4) r(i)""",
)
def four_hz_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_samples(spark, sf_dir).withColumn("rate", F.array(*[F.col(f"s{i}") for i in range(4)]))
    wide = expand.expand_samples(rows, "l_shipdate", {"rate": F.col("rate")})
    return wide.select(
        "l_orderkey", "l_linenumber", "l_partkey", "sample", F.col("l_shipdate").alias("moment"), "rate"
    )


@query(
    "one_hz_downsample",
    f"""WITH {SAMPLES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg([s0, s1, s2, s3]), 6) AS mean_rate,
        CAST(s0 AS DOUBLE) AS first_rate FROM samples""",
)
def one_hz_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = F.array(*[F.col(f"s{i}") for i in range(4)])
    return line_samples(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        six(signal.one_hz_value(samples), "mean_rate"),
        signal.one_hz_value(samples, "first").alias("first_rate"),
    )


POINTS = 240

GRID_SQL = f"""
hours AS (SELECT user_id, date_trunc('hour', ts) AS h, avg(value) AS value FROM events GROUP BY 1, 2),
ends AS (SELECT user_id, max(h) AS last_h FROM hours WHERE value BETWEEN 30 AND 240 GROUP BY 1),
grid AS (
    SELECT e.user_id, CAST(g.i AS INTEGER) AS position, e.last_h - to_hours(CAST({POINTS - 1} - g.i AS BIGINT)) AS h, x.value,
           x.value IS NULL OR x.value NOT BETWEEN 30 AND 240 AS filtered
    FROM ends e CROSS JOIN range({POINTS}) g(i)
    LEFT JOIN hours x ON x.user_id = e.user_id AND x.h = e.last_h - to_hours(CAST({POINTS - 1} - g.i AS BIGINT)))"""

# Daily grid for the filters: one grid step counts as one second.
DAYS = 30

DENSE_SQL = f"""
days AS (SELECT user_id, date_trunc('day', ts) AS h, avg(value) AS value FROM events GROUP BY 1, 2),
ends AS (SELECT user_id, max(h) AS last_h FROM days WHERE value BETWEEN 30 AND 240 GROUP BY 1),
dense AS (
    SELECT e.user_id, CAST(g.i AS INTEGER) AS position, x.value, x.value IS NULL OR x.value NOT BETWEEN 30 AND 240 AS filtered
    FROM ends e CROSS JOIN range({DAYS}) g(i)
    LEFT JOIN days x ON x.user_id = e.user_id AND x.h = e.last_h - to_days(CAST({DAYS - 1} - g.i AS INTEGER)))"""

HAMPEL_SQL = f"""{DENSE_SQL},
usable AS (SELECT *, CASE WHEN NOT filtered THEN value END AS v FROM dense),
m1 AS (SELECT *, CASE WHEN count(v) OVER w = 5 THEN quantile_cont(v, 0.5) OVER w END AS med FROM usable
       WINDOW w AS (PARTITION BY user_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m2 AS (SELECT *, CASE WHEN count(abs(v - med)) OVER w = 5 THEN quantile_cont(abs(v - med), 0.5) OVER w END AS mad FROM m1
       WINDOW w AS (PARTITION BY user_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
hampel AS (SELECT user_id, position, value, filtered OR coalesce(abs(v - med) > mad * (3.0 * 1.4826), FALSE) AS filtered FROM m2)"""

SPIKE_SQL = f"""{HAMPEL_SQL},
spike AS (SELECT user_id, position, value, filtered OR coalesce(abs(value - lag(value) OVER w) > 20 AND abs(value - lead(value) OVER w) > 20, FALSE) AS filtered
          FROM hampel WINDOW w AS (PARTITION BY user_id ORDER BY position))"""

FILL_SQL = f"""{SPIKE_SQL},
sides AS (
    SELECT *, last_value(CASE WHEN NOT filtered THEN position END IGNORE NULLS) OVER l AS lp, last_value(CASE WHEN NOT filtered THEN value END IGNORE NULLS) OVER l AS lv,
           first_value(CASE WHEN NOT filtered THEN position END IGNORE NULLS) OVER r AS rp, first_value(CASE WHEN NOT filtered THEN value END IGNORE NULLS) OVER r AS rv
    FROM spike WINDOW l AS (PARTITION BY user_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                      r AS (PARTITION BY user_id ORDER BY position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fills AS (SELECT *, filtered AND lp IS NOT NULL AND rp IS NOT NULL AND position - lp <= 2 AS hit FROM sides),
filled AS (SELECT user_id, position, CASE WHEN hit THEN lv + (rv - lv) * ((position - lp) / (rp - lp)) ELSE value END AS value,
                  filtered AND NOT hit AS filtered FROM fills)"""

KALMAN_SQL = f"""RECURSIVE {FILL_SQL},
scan AS (
    SELECT user_id, position, CASE WHEN NOT filtered THEN value END AS est, CAST(1 AS DOUBLE) AS var, CASE WHEN NOT filtered THEN value END AS smooth
    FROM filled WHERE position = 0
    UNION ALL
    SELECT f.user_id, f.position,
           CASE WHEN f.filtered THEN s.est WHEN s.est IS NULL THEN f.value ELSE s.est + (s.var + 1) / (s.var + 5) * (f.value - s.est) END,
           CASE WHEN s.est IS NULL THEN 1 WHEN f.filtered THEN s.var + 1 ELSE (1 - (s.var + 1) / (s.var + 5)) * (s.var + 1) END,
           CASE WHEN f.filtered THEN NULL WHEN s.est IS NULL THEN f.value ELSE s.est + (s.var + 1) / (s.var + 5) * (f.value - s.est) END
    FROM scan s JOIN filled f ON f.user_id = s.user_id AND f.position = s.position + 1)"""


@query(
    "grid_align",
    f"WITH {GRID_SQL} SELECT user_id, position, h, round(value, 6) AS value, filtered FROM grid",
)
def grid_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    hourly = rows.select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("h"), "value")
    grid = denoise.grid_align(hourly, "user_id", "h", "value", HOUR, POINTS)
    return grid.select("user_id", "position", "h", six(F.col("value"), "value"), "filtered")


def dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of each user on a grid that ends at the last plausible day."""
    rows = table(spark, sf_dir, "events")
    daily = rows.select("user_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("h"), "value")
    return denoise.grid_align(daily, "user_id", "h", "value", DAY, DAYS).drop("h")


def _flags(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "position", six(F.col("value"), "value"), "filtered")


@query("hampel", f"WITH {HAMPEL_SQL} SELECT user_id, position, round(value, 6) AS value, filtered FROM hampel")
def hampel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(denoise.hampel(dense_series(spark, sf_dir), "user_id", "value", 1.0))


@query("spike", f"WITH {SPIKE_SQL} SELECT user_id, position, round(value, 6) AS value, filtered FROM spike")
def spike(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = denoise.hampel(dense_series(spark, sf_dir), "user_id", "value", 1.0)
    return _flags(denoise.spikes(flagged, "user_id", "value"))


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = denoise.hampel(dense_series(spark, sf_dir), "user_id", "value", 1.0)
    return denoise.interpolate_short(denoise.spikes(flagged, "user_id", "value"), "user_id", "value", 1.0)


@query("interpolate_short", f"WITH {FILL_SQL} SELECT user_id, position, round(value, 6) AS value, filtered FROM filled")
def interpolate_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(_filled(spark, sf_dir))


@query("kalman", f"WITH {KALMAN_SQL} SELECT user_id, position, round(smooth, 6) AS value, filtered FROM scan JOIN filled USING (user_id, position)")
def kalman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(denoise.kalman_smooth(_filled(spark, sf_dir), "user_id", "value"))


@query(
    "valid_ratio",
    f"""WITH {GRID_SQL} SELECT user_id, round(avg(CASE WHEN filtered THEN 0.0 ELSE 1.0 END), 6) AS valid_share
    FROM grid GROUP BY 1 HAVING avg(CASE WHEN filtered THEN 0.0 ELSE 1.0 END) >= 0.05""",
)
def valid_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    hourly = rows.select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("h"), "value")
    grid = denoise.grid_align(hourly, "user_id", "h", "value", HOUR, POINTS)
    kept = denoise.keep_complete(grid, "user_id", 0.05)
    share = F.avg(F.when(F.col("filtered"), 0.0).otherwise(1.0))
    return kept.groupBy("user_id").agg(six(share, "valid_share"))


@query(
    "denoise",
    f"""WITH {KALMAN_SQL} SELECT user_id, position, round(smooth, 6) AS value, filtered
    FROM scan JOIN filled USING (user_id, position)
    WHERE user_id IN (SELECT user_id FROM filled GROUP BY 1 HAVING avg(CASE WHEN filtered THEN 0.0 ELSE 1.0 END) >= 0.5)""",
)
def denoise_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    daily = rows.select("user_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("h"), "value")
    found = denoise.denoise(
        daily, "user_id", "h", "value", step_seconds=DAY, points=DAYS, window_seconds=2 * DAY, max_gap_seconds=2 * DAY
    )
    return _flags(found)


@query(
    "merge_instants",
    "SELECT user_id, date_trunc('hour', ts) AS h, round(avg(value), 6) AS value FROM events GROUP BY 1, 2",
)
def merge_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    hourly = rows.select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("h"), "value")
    return denoise.merge_instants(hourly, "user_id", "h", ["value"]).select("user_id", "h", six(F.col("value"), "value"))


@query(
    "plausible_range",
    "SELECT event_id, value FROM events WHERE value BETWEEN 30 AND 240",
)
def plausible_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return rows.where(~denoise.out_of_range(F.col("value")))
