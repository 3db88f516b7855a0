"""Queries on the event series: time filter, sessions, episodes, closing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import (
    EVENT_EPISODE_GAP,
    EVENT_GAP,
    EVENT_SALT,
    EVENT_WINDOW,
    DAY,
    query,
    six,
    table,
)
from vitalspan.config import ReductionSettings
from vitalspan.functions import dates, keys, text
from vitalspan.operators import cells, sessions
from vitalspan.plans import reduction

SETTINGS = ReductionSettings(
    salt=EVENT_SALT,
    gap_minutes=EVENT_GAP / 60,
    episode_gap_days=EVENT_EPISODE_GAP / DAY,
    window_minutes=EVENT_WINDOW / 60,
)

SESSIONED_SQL = """
ordered AS (
    SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev_ts FROM events
),
sessioned AS (
    SELECT *, CAST(sum(CASE WHEN prev_ts IS NULL OR ts - prev_ts > INTERVAL 6 HOURS THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_id
    FROM ordered
),
sess AS (
    SELECT user_id, session_id, min(ts) AS session_start, max(ts) AS session_end,
           max(ts) FILTER (WHERE value > 0) AS last_positive_ts, count(*) AS n_rows
    FROM sessioned GROUP BY 1, 2
),
prevs AS (
    SELECT *, lag(session_end) OVER (PARTITION BY user_id ORDER BY session_end) AS prev_end FROM sess
),
episodes AS (
    SELECT *, CAST(sum(CASE WHEN prev_end IS NULL OR session_end - prev_end > INTERVAL 2 DAYS THEN 1 ELSE 0 END)
               OVER (PARTITION BY user_id ORDER BY session_end) AS BIGINT) AS episode_id
    FROM prevs
),
finals AS (
    SELECT * FROM (
        SELECT *, max(session_end) OVER (PARTITION BY user_id, episode_id) AS episode_end FROM episodes
    ) WHERE session_end = episode_end
)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "time_cutoff",
    "SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'",
)
def time_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = reduction.time_filter(_events(spark, sf_dir), "2024-01-10", ts="ts")
    return kept.select("event_id", "ts", "user_id", "value")


@query(
    "session_gap",
    """SELECT event_id, round(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
              AS DOUBLE) / 1000000.0, 6) AS gap_seconds FROM events""",
)
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    with_prev = cells.with_previous(rows, ["user_id"], "ts", {"prev_ts": "ts"}, DAY, tie=["event_id"])
    return with_prev.select("event_id", six(dates.duration_seconds(F.col("prev_ts"), F.col("ts")), "gap_seconds"))


@query(
    "sessionize",
    f"WITH {SESSIONED_SQL} SELECT user_id, session_id, session_start, session_end, n_rows FROM sess",
)
def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.session_table(_events(spark, sf_dir), "user_id", "ts", EVENT_GAP)
    return found.select("user_id", "session_id", "session_start", "session_end", "n_rows")


@query("sessionize_rows", f"WITH {SESSIONED_SQL} SELECT event_id, user_id, session_id FROM sessioned")
def sessionize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return sessions.assign_sessions(rows, "user_id", "ts", EVENT_GAP).drop("ts")


@query(
    "session_window_equiv",
    f"WITH {SESSIONED_SQL} SELECT user_id, session_start, session_end, n_rows FROM sess",
)
def session_window_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in session window; its end is the last row plus the gap."""
    rows = _events(spark, sf_dir)
    grouped = rows.groupBy("user_id", F.session_window("ts", f"{EVENT_GAP} seconds").alias("w"))
    counted = grouped.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(
        "user_id",
        F.col("w.start").cast("timestamp_ntz").alias("session_start"),
        dates.plus_seconds(F.col("w.end").cast("timestamp_ntz"), -EVENT_GAP).alias("session_end"),
        "n_rows",
    )


@query(
    "episode_grouping",
    f"""WITH {SESSIONED_SQL}
    SELECT user_id, session_id, episode_id, session_end,
           session_end = max(session_end) OVER (PARTITION BY user_id, episode_id) AS is_last_session
    FROM episodes""",
)
def episode_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.session_table(_events(spark, sf_dir), "user_id", "ts", EVENT_GAP)
    flagged = sessions.episode_table(found, "user_id", EVENT_EPISODE_GAP)
    return flagged.select("user_id", "session_id", "episode_id", "session_end", "is_last_session")


@query(
    "episode_count",
    f"WITH {SESSIONED_SQL} SELECT count(*) AS n_episodes FROM (SELECT DISTINCT user_id, episode_id FROM episodes)",
)
def episode_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.count_episodes(_events(spark, sf_dir), "user_id", "ts", EVENT_GAP, EVENT_EPISODE_GAP)


@query(
    "closing_windows",
    f"""WITH {SESSIONED_SQL}
    SELECT user_id, episode_id, coalesce(last_positive_ts, session_end) AS window_end,
           greatest(session_start, coalesce(last_positive_ts, session_end) - INTERVAL 12 HOURS) AS window_start
    FROM finals""",
)
def closing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.closing_windows(
        _events(spark, sf_dir), "user_id", "ts", "value", EVENT_GAP, EVENT_EPISODE_GAP, EVENT_WINDOW
    )
    return found.select("user_id", "episode_id", "window_end", "window_start")


STAGE3_SQL = f"""WITH {SESSIONED_SQL}
SELECT sha256(concat('{EVENT_SALT}', '|', CAST(s.user_id AS VARCHAR), '|', CAST(f.session_end AS VARCHAR))) AS subject_id,
       s.user_id, s.event_id, s.ts, s.value, s.event_type
FROM sessioned s JOIN finals f ON s.user_id = f.user_id AND s.session_id = f.session_id
WHERE s.ts BETWEEN coalesce(f.last_positive_ts, f.session_end) - INTERVAL 12 HOURS
               AND coalesce(f.last_positive_ts, f.session_end)"""


@query("stage3_session_filter", STAGE3_SQL)
def stage3_session_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_id", "ts", "value", "event_type")
    return reduction.closing_session_rows(rows, SETTINGS, "user_id", "ts", "value", "subject_id")


@query(
    "hash_id",
    "SELECT event_id, sha256(concat('salt', '|', CAST(user_id AS VARCHAR), '|', CAST(ts AS VARCHAR))) AS subject_id FROM events",
)
def hash_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return rows.select("event_id", keys.salted_key(EVENT_SALT, F.col("user_id"), F.col("ts")).alias("subject_id"))


@query(
    "bucket_assign",
    "SELECT c_custkey, CAST(CAST(right(c_name, 4) AS INTEGER) % 16 AS INTEGER) AS bucket FROM customer",
)
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", text.suffix_bucket(F.col("c_name"), 16).alias("bucket"))
