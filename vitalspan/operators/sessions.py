"""Gap sessions, longer episodes and the closing window of each episode.

Rows of one key that share a cell no wider than the session gap are always in the
same session, so sessions follow exactly from one summary row per (key, cell).  The
raw rows are only pre-aggregated and, at the end, joined to the short windows kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.dates import MICROS, epoch_micros, plus_seconds, time_cell
from vitalspan.operators.cells import CELL, with_cell
from vitalspan.operators.prefilter import rows_that_may_match


def _longer_than(start: Column, end: Column, seconds: float) -> Column:
    return epoch_micros(end) - epoch_micros(start) > int(round(seconds * MICROS))


def activity_cells(rows: DataFrame, key: str, ts: str, gap_seconds: float, value: str | None = None) -> DataFrame:
    """One row per (key, cell): first and last time, last time with a positive value, row count."""
    usable = rows.dropna(subset=[key, ts])
    positive = F.lit(None).cast(usable.schema[ts].dataType)
    if value is not None:
        signal = F.col(value)
        positive = F.when((signal > 0) & ~F.isnan(signal.cast("double")), F.col(ts))
    return (
        with_cell(usable, ts, gap_seconds)
        .groupBy(key, CELL)
        .agg(
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
            F.max(positive).alias("last_positive_ts"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def number_cells(cells: DataFrame, key: str, gap_seconds: float) -> DataFrame:
    """Add the session number of every cell; a gap strictly above the limit starts a session."""
    in_order = Window.partitionBy(key).orderBy(CELL)
    before = F.lag("last_ts").over(in_order)
    opens = F.when(before.isNull() | _longer_than(before, F.col("first_ts"), gap_seconds), 1).otherwise(0)
    return cells.withColumn("_opens", opens).withColumn("session_id", F.sum("_opens").over(in_order)).drop("_opens")


def session_table(rows: DataFrame, key: str, ts: str, gap_seconds: float, value: str | None = None) -> DataFrame:
    """One row per session: number, start, end, last positive time, row count."""
    cells = number_cells(activity_cells(rows, key, ts, gap_seconds, value), key, gap_seconds)
    return cells.groupBy(key, "session_id").agg(
        F.min("first_ts").alias("session_start"),
        F.max("last_ts").alias("session_end"),
        F.max("last_positive_ts").alias("last_positive_ts"),
        F.sum("n_rows").alias("n_rows"),
    )


def assign_sessions(rows: DataFrame, key: str, ts: str, gap_seconds: float) -> DataFrame:
    """Every row with the number of its session."""
    cells = number_cells(activity_cells(rows, key, ts, gap_seconds), key, gap_seconds)
    numbered = with_cell(rows, ts, gap_seconds).join(cells.select(key, CELL, "session_id"), [key, CELL])
    return numbered.select(*rows.columns, "session_id")


def episode_table(sessions: DataFrame, key: str, episode_gap_seconds: float) -> DataFrame:
    """Sessions with an episode number and a flag on the last session of each episode.

    The gap is measured from session end to session end.
    """
    in_order = Window.partitionBy(key).orderBy("session_id")
    before = F.lag("session_end").over(in_order)
    opens = F.when(before.isNull() | _longer_than(before, F.col("session_end"), episode_gap_seconds), 1).otherwise(0)
    flagged = sessions.withColumn("_opens", opens)
    return flagged.select(
        *sessions.columns,
        F.sum("_opens").over(in_order).alias("episode_id"),
        (F.coalesce(F.lead("_opens").over(in_order), F.lit(1)) == 1).alias("is_last_session"),
    )


def closing_windows(
    rows: DataFrame,
    key: str,
    ts: str,
    value: str,
    gap_seconds: float,
    episode_gap_seconds: float,
    window_seconds: float,
) -> DataFrame:
    """One row per episode: the last session and the window that ends it.

    The window ends at the last positive reading of the session (the session end when
    there is none) and reaches back ``window_seconds``, both ends included.
    """
    sessions = session_table(rows, key, ts, gap_seconds, value)
    last = episode_table(sessions, key, episode_gap_seconds).where("is_last_session").drop("is_last_session")
    anchor = F.coalesce("last_positive_ts", "session_end")
    return last.withColumn("window_end", anchor).withColumn(
        "window_start", F.greatest(F.col("session_start"), plus_seconds(F.col("window_end"), -window_seconds))
    )


def rows_in_windows(
    rows: DataFrame, windows: DataFrame, key: str, ts: str, start: str, end: str, cell_seconds: float
) -> DataFrame:
    """Rows whose time lies in a window of their key, both ends included.

    The range condition becomes an equi-join on (key, time cell), so the rows of one
    key are spread over its cells.  Few rows lie in a touched cell: a bitmap of the
    touched (key, cell) pairs drops the others where they are read, before any exchange.
    """
    cells = F.sequence(time_cell(F.col(start), cell_seconds), time_cell(F.col(end), cell_seconds))
    touched = windows.withColumn(CELL, F.explode(cells))
    near = rows_that_may_match(with_cell(rows, ts, cell_seconds), touched, [key, CELL])
    inside = near.join(touched, [key, CELL])
    return inside.where(F.col(ts).between(F.col(start), F.col(end))).drop(CELL)


def count_episodes(rows: DataFrame, key: str, ts: str, gap_seconds: float, episode_gap_seconds: float) -> DataFrame:
    sessions = session_table(rows, key, ts, gap_seconds)
    last = episode_table(sessions, key, episode_gap_seconds).where("is_last_session")
    return last.agg(F.count(F.lit(1)).alias("n_episodes"))
