"""Whole stages and sources through the functions that ship, each against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import as_double, query, six, table
from vitalspan.catalog.modelling import study_runs
from vitalspan.catalog.signals import BYTES_SQL, SAMPLES_SQL, TEXT64, line_samples
from vitalspan.operators import evaluation
from vitalspan.plans import cohort, reduction, study
from vitalspan.sources import tables

WEEK_MINUTES = 7 * 24 * 60
PICK_SQL = "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('7|' || CAST(user_id AS VARCHAR)) LIMIT 1"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("BabyID"),
        F.col("ts").alias("Timestamp"),
        F.col("value").alias("FHR"),
        (F.col("value") * 2).alias("toco"),
    )


@query("pick_subject", f'SELECT CAST(user_id AS VARCHAR) AS "BabyID" FROM ({PICK_SQL})')
def pick_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.pick_subject(_series(spark, sf_dir), 7)


@query(
    "trace",
    f"""WITH r AS (SELECT ts, value FROM events WHERE user_id = ({PICK_SQL}))
    SELECT ts AS "Timestamp", value AS "FHR", value * 2 AS toco FROM r
    WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL {WEEK_MINUTES} MINUTE""",
)
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week of the picked subject, by the function behind the command line."""
    series = _series(spark, sf_dir)
    return cohort.trace(series, cohort.pick_subject(series, 7).first()["BabyID"], WEEK_MINUTES)


@query(
    "derive_signals",
    f"""WITH {SAMPLES_SQL}, {BYTES_SQL},
    rates AS (SELECT l_orderkey, l_linenumber, l_partkey, [x FOR x IN [s0, s1, s2, s3] IF x > 0] AS p FROM samples),
    levels AS (SELECT l_orderkey, l_linenumber, l_partkey, round(CAST(CAST(CASE WHEN len(g) > 0 THEN list_avg(g)
        WHEN len(v) > 0 THEN list_avg(v) ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS toco FROM good)
    SELECT CAST(l_partkey AS VARCHAR) AS "PatientID", l_orderkey * 10 + l_linenumber AS "RegistrationID",
        CAST(CASE WHEN len(p) > 0 THEN list_sum(p) // len(p) ELSE 0 END AS DOUBLE) AS "FHR", toco
    FROM rates JOIN levels USING (l_orderkey, l_linenumber, l_partkey)""",
)
def derive_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    texts = table(spark, sf_dir, "lineitem").selectExpr(*keys, f"{TEXT64} AS Toco_Values")
    raw = line_samples(spark, sf_dir).join(texts, keys).select(
        F.col("l_shipdate").alias("Timestamp"),
        F.col("l_partkey").cast("string").alias("PatientID"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("RegistrationID"),
        *[F.col(f"s{i}").cast("int").alias(f"Hr1_{i}") for i in range(4)],
        "Toco_Values",
    )
    found = reduction.derive_signals(raw)
    return found.select(
        "PatientID", "RegistrationID", F.col("FHR").cast("double").alias("FHR"), F.round(F.col("toco").cast("double"), 4).alias("toco")
    )


@query(
    "study_wide_summary",
    """WITH runs AS (SELECT l_linenumber AS seed, CASE l_returnflag WHEN 'N' THEN 'baseline' ELSE 'without_' || l_returnflag END AS ablation,
        CASE l_linestatus WHEN 'O' THEN 'apgar1_below7' ELSE 'apgar5_below7' END AS outcome, avg(l_discount) AS value FROM lineitem GROUP BY 1, 2, 3),
    everything AS (SELECT * FROM runs UNION ALL SELECT seed, ablation, 'apgar_mean_below7', avg(value) FROM runs GROUP BY 1, 2),
    deltas AS (SELECT r.ablation, r.outcome, b.value - r.value AS d FROM everything r
        JOIN everything b ON r.seed = b.seed AND r.outcome = b.outcome AND b.ablation = 'baseline')
    SELECT ablation, round(avg(d) FILTER (WHERE outcome = 'apgar_mean_below7'), 6) AS mean_drop,
        round(CASE WHEN count(d) FILTER (WHERE outcome = 'apgar_mean_below7') = 1 THEN 0
              ELSE stddev_samp(d) FILTER (WHERE outcome = 'apgar_mean_below7') END, 6) AS sd_drop,
        round(avg(d) FILTER (WHERE outcome = 'apgar5_below7'), 6) AS five_minutes FROM deltas GROUP BY 1""",
)
def study_wide_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean outcome added, deltas, summary, one wide line per removal."""
    named = F.when(F.col("outcome") == "O", "apgar1_below7").otherwise("apgar5_below7")
    runs = study.with_mean_outcome(study_runs(spark, sf_dir).withColumn("outcome", named))
    summary = evaluation.removal_summary(evaluation.removal_deltas(runs))
    wide = study.wide_summary(summary, [study.MEAN_OUTCOME, "apgar5_below7"])
    return wide.select(
        "ablation",
        six(F.col(f"{study.MEAN_OUTCOME}_mean_drop_roc_auc"), "mean_drop"),
        six(F.col(f"{study.MEAN_OUTCOME}_sd_drop_roc_auc"), "sd_drop"),
        six(F.col("apgar5_below7_mean_drop_roc_auc"), "five_minutes"),
    )


@query(
    "unified_schemas",
    """SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey,
        CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name
    FROM (SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region)""",
)
def unified_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of different columns read as one."""
    files = [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in ("nation", "region")]
    found = tables.read_unified_parquet(spark, files)
    return as_double(found, "n_nationkey", "n_regionkey", "r_regionkey")


@query(
    "rows_per_table_file",
    """SELECT 'orders' AS name, count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part""",
)
def rows_per_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in ("orders", "part"):
        counts = tables.rows_per_file(table(spark, sf_dir, name).select(F.lit(name).alias("name")))
        counts = counts.select(F.regexp_extract("file", r"([a-z]+)\.parquet", 1).alias("name"), "n_rows")
        found = counts if found is None else found.unionByName(counts)
    return found.groupBy("name").agg(F.sum("n_rows").alias("n_rows"))
