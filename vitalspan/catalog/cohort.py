"""Queries on duplicate filtering, quality, dating, matching and cohort counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import as_double, as_text, query, six, table
from vitalspan.operators import dedup, matching, quality, reports
from vitalspan.operators.skew import dealt, join_per_key

TOCO_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their day as the instant and the JSON number as a second signal."""
    rows = table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        "user_id",
        F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("toco"),
        "event_type",
    )


DUP_SQL = """
per_day AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2),
rates AS (SELECT user_id, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS dup_ts, count(*) AS total_ts
          FROM per_day GROUP BY 1)"""


@query(
    "dup_rates",
    f"WITH {DUP_SQL} SELECT user_id, dup_ts, total_ts, round(CAST(dup_ts AS DOUBLE) / total_ts, 6) AS dup_rate FROM rates",
)
def dup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = dedup.duplicate_rates(daily_events(spark, sf_dir), "user_id", "day")
    return rates.select("user_id", "dup_ts", "total_ts", six(F.col("dup_rate"), "dup_rate"))


@query(
    "dup_rate_filter",
    f"""WITH {DUP_SQL} SELECT event_id, user_id FROM events
    WHERE user_id IN (SELECT user_id FROM rates WHERE CAST(dup_ts AS DOUBLE) / total_ts <= 0.7)""",
)
def dup_rate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.drop_noisy_keys(daily_events(spark, sf_dir), "user_id", "day", 0.7)
    return kept.select("event_id", "user_id")


VOTE_SQL = f"""
src AS (SELECT user_id, date_trunc('day', ts) AS day, value, {TOCO_SQL} AS toco, event_type FROM events),
votes AS (SELECT user_id, day, event_type, count(*) AS n FROM src GROUP BY 1, 2, 3),
winner AS (SELECT user_id, day, event_type FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC, event_type) AS place FROM votes)
    WHERE place = 1),
signals AS (
    SELECT user_id, day,
           coalesce(median(value) FILTER (WHERE value > 0), 0) AS value,
           coalesce(median(toco) FILTER (WHERE toco BETWEEN 1 AND 99), median(toco)) AS toco
    FROM src GROUP BY 1, 2)"""


@query(
    "per_second_vote",
    f"""WITH {VOTE_SQL}
    SELECT s.user_id, s.day, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 3) AS value,
           round(CAST(CAST(toco AS FLOAT) AS DOUBLE), 3) AS toco, w.event_type
    FROM signals s JOIN winner w USING (user_id, day)""",
)
def per_second_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = dedup.vote_per_instant(daily_events(spark, sf_dir), ["user_id", "day"], "value", "toco", ["event_type"])
    return voted.select(
        "user_id",
        "day",
        F.round(F.col("value").cast("double"), 3).alias("value"),
        F.round(F.col("toco").cast("double"), 3).alias("toco"),
        "event_type",
    )


@query(
    "quality_filter",
    """SELECT event_id, user_id FROM events WHERE user_id IN (
        SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 50) >= 24)""",
)
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return quality.keep_informative(rows, "user_id", "ts", F.col("value") > 50, 24).select("event_id", "user_id")


ANCHOR_SQL = """SELECT event_id, user_id, ts, CAST(CAST(max(ts) OVER (PARTITION BY user_id) AS DATE) AS VARCHAR) AS anchor_date FROM events"""


@query("anchor_date_join", ANCHOR_SQL)
def anchor_date_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return as_text(quality.with_anchor_date(rows, "user_id", "ts", "anchor_date"), "anchor_date")


@query("sorted_export", ANCHOR_SQL)
def sorted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_date_join(spark, sf_dir).orderBy("anchor_date", "user_id", "ts")


@query(
    "semi_join_keep",
    """SELECT o_orderkey, o_custkey FROM orders
    WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def semi_join_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    keys = keep.select(F.col("c_custkey").alias("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return join_per_key(rows, keys, "o_custkey", spread_by=["o_orderkey"], how="left_semi")


@query(
    "left_join_preagg",
    """SELECT o.o_orderkey, o.o_totalprice, CAST(l.n_lines AS DOUBLE) AS n_lines, l.max_quantity, CAST(l.any_returned AS VARCHAR) AS any_returned
    FROM orders o LEFT JOIN (
        SELECT l_orderkey, count(*) AS n_lines, max(l_quantity) AS max_quantity, bool_or(l_returnflag = 'R') AS any_returned
        FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) l ON o.o_orderkey = l.l_orderkey""",
)
def left_join_preagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_discount") > 0.05)
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.max("l_quantity").alias("max_quantity"),
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return as_double(as_text(orders.join(per_order, "o_orderkey", "left"), "any_returned"), "n_lines")


@query(
    "bool_or_filter",
    """SELECT l_orderkey, CAST(bool_or(l_tax > 0.06) FILTER (WHERE l_discount > 0.02) AS VARCHAR) AS any_taxed,
           max(l_quantity) FILTER (WHERE l_discount > 0.02) AS max_quantity
    FROM lineitem GROUP BY 1""",
)
def bool_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.col("l_discount") > 0.02
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.when(chosen, F.col("l_tax") > 0.06)).alias("any_taxed"),
        F.max(F.when(chosen, F.col("l_quantity"))).alias("max_quantity"),
    )
    return as_text(found, "any_taxed")


MATCH_SQL = """
reg AS (SELECT o_orderkey, o_custkey AS person, CAST(o_orderdate AS DATE) AS birth_day FROM orders),
rec AS (SELECT DISTINCT o.o_custkey AS person, l.l_orderkey AS subject, CAST(l.l_shipdate AS DATE) AS day
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
pairs AS (SELECT r.o_orderkey, r.person, r.birth_day, m.subject, m.day
          FROM reg r JOIN rec m ON r.person = m.person AND (m.day = r.birth_day OR m.day = r.birth_day - INTERVAL 1 DAY)),
counted AS (SELECT *, count(*) OVER (PARTITION BY o_orderkey) AS n_matches FROM pairs)"""


def order_registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as registry rows, shipped lines as recordings of the same customer."""
    orders = table(spark, sf_dir, "orders")
    registry = orders.select(
        "o_orderkey", F.col("o_custkey").alias("person"), F.col("o_orderdate").cast("date").alias("birth_day")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("date").alias("day")
    )
    owners = orders.select("o_orderkey", F.col("o_custkey").alias("person"))
    joined = dealt(lines, "o_orderkey").join(dealt(owners, "o_orderkey"), "o_orderkey").withColumnRenamed("o_orderkey", "subject")
    return registry, matching.recording_map(joined, "subject", "person", "day")


@query(
    "or_date_match",
    f"""WITH {MATCH_SQL} SELECT o_orderkey, person, CAST(birth_day AS VARCHAR) AS birth_day, CAST(day AS VARCHAR) AS day,
        count(*) AS n_recordings, min(subject) AS subject FROM pairs GROUP BY 1, 2, 3, 4""",
)
def or_date_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, recordings = order_registry(spark, sf_dir)
    found = matching.matches_per_day(registry, recordings, "person", "birth_day", "subject", "day")
    columns = found.select("o_orderkey", "person", "birth_day", "day", "n_recordings", "subject")
    return as_text(columns, "birth_day", "day")


@query(
    "unique_match_filter",
    f"WITH {MATCH_SQL} SELECT o_orderkey, person, CAST(birth_day AS VARCHAR) AS birth_day, subject, CAST(day AS VARCHAR) AS day FROM counted WHERE n_matches = 1",
)
def unique_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, recordings = order_registry(spark, sf_dir)
    single = matching.unique_matches(registry, recordings, "person", "birth_day", "subject", "day")
    return as_text(single.select("o_orderkey", "person", "birth_day", "subject", "day"), "birth_day", "day")


@query(
    "unique_match_subjects",
    f"""WITH {MATCH_SQL}, single AS (SELECT * FROM counted WHERE n_matches = 1)
    SELECT o_orderkey, subject FROM (
        SELECT *, count(*) OVER (PARTITION BY subject) AS claims FROM single) WHERE claims = 1""",
)
def unique_match_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, recordings = order_registry(spark, sf_dir)
    single = matching.unique_matches(
        registry, recordings, "person", "birth_day", "subject", "day", unique_on="subject"
    )
    return single.select("o_orderkey", "subject")


@query(
    "multi_match_count",
    f"WITH {MATCH_SQL} SELECT count(DISTINCT o_orderkey) AS n_rows FROM counted WHERE n_matches > 1",
)
def multi_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry, recordings = order_registry(spark, sf_dir)
    found = matching.matches_per_row(registry, recordings, "person", "birth_day", "subject", "day")
    return found.where(F.col("n_matches") > 1).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "duplicated_keys",
    "SELECT l_orderkey, l_partkey, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query(
    "overlap_count",
    "SELECT count(*) AS n_overlap FROM (SELECT DISTINCT user_id FROM events) e JOIN customer c ON e.user_id = c.c_custkey",
)
def overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return reports.overlap(table(spark, sf_dir, "events"), people, "user_id")


@query(
    "cohort_counts",
    """SELECT 'events' AS stage, count(*) AS n_rows, count(DISTINCT user_id) AS n_patients, CAST(NULL AS DOUBLE) AS n_subjects FROM events
    UNION ALL SELECT 'orders', count(*), count(DISTINCT o_custkey), count(DISTINCT o_orderkey) FROM orders
    UNION ALL SELECT 'lineitem', count(*), count(DISTINCT l_suppkey), count(DISTINCT l_orderkey) FROM lineitem""",
)
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        reports.stage_counts(table(spark, sf_dir, "events"), "events", "user_id", None),
        reports.stage_counts(table(spark, sf_dir, "orders"), "orders", "o_custkey", "o_orderkey"),
        reports.stage_counts(table(spark, sf_dir, "lineitem"), "lineitem", "l_suppkey", "l_orderkey"),
    ]
    return as_double(parts[0].unionByName(parts[1]).unionByName(parts[2]), "n_subjects")


@query(
    "fd_check",
    """SELECT o_custkey AS registration, min(o_orderpriority) AS first_owner, max(o_orderpriority) AS last_owner,
           count(DISTINCT o_orderpriority) AS n_owners
    FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""",
)
def fd_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "registration")
    return reports.conflicting_owners(rows, "registration", "o_orderpriority").select(
        "registration", "first_owner", "last_owner", "n_owners"
    )


@query(
    "set_per_day",
    """SELECT user_id, CAST(day AS VARCHAR) AS day, event_type, count(*) OVER (PARTITION BY user_id, day) AS n_registrations
    FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events)""",
)
def set_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return as_text(reports.registrations_per_day(rows, "user_id", "ts", "event_type"), "day")


@query(
    "verify_rows_per_key",
    """SELECT conv_id, count(*) AS n_rows FROM conversations GROUP BY 1 HAVING count(*) <> 4""",
)
def verify_rows_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unexpected_row_counts(table(spark, sf_dir, "conversations"), "conv_id", 4)


@query(
    "verify_output",
    """SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_subjects, min(ts) AS first_ts, max(ts) AS last_ts,
           round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS value_missing_ratio FROM events""",
)
def verify_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") >= 50, F.col("value")))
    found = reports.output_summary(rows, "user_id", "ts", ["value"])
    return found.withColumn("value_missing_ratio", F.round("value_missing_ratio", 6))


@query(
    "spacing_mode",
    """WITH hours AS (SELECT DISTINCT user_id, date_trunc('hour', ts) AS h FROM events),
    gaps AS (SELECT user_id, epoch(h) - epoch(lag(h) OVER (PARTITION BY user_id ORDER BY h)) AS spacing_seconds FROM hours),
    tally AS (SELECT user_id, spacing_seconds, count(*) AS n FROM gaps WHERE spacing_seconds IS NOT NULL GROUP BY 1, 2)
    SELECT user_id, spacing_seconds FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, spacing_seconds) AS place FROM tally)
    WHERE place = 1""",
)
def spacing_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    hours = rows.select("user_id", F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("h")).distinct()
    return reports.modal_spacing(hours, "user_id", "h", cell_seconds=86_400)
