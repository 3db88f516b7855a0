from __future__ import annotations

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vitalspan.config import ReductionSettings
from vitalspan.operators import cells, sessions
from vitalspan.plans import reduction

T0 = datetime(2020, 1, 1, 12, 0, 0)
GAP, EPISODE, WINDOW = 300, 200 * 86_400, 3600


def series(spark, rows):
    schema = "pid string, ts timestamp_ntz, v float"
    return spark.createDataFrame(rows, schema)


def at(seconds: float) -> datetime:
    return T0 + timedelta(microseconds=round(seconds * 1e6))


def brute(rows, gap=GAP, episode=EPISODE, window=WINDOW):
    """Rows kept per episode, straight from the definition."""
    out = set()
    by_pid: dict[str, list] = {}
    for pid, ts, v in rows:
        if pid is not None and ts is not None:
            by_pid.setdefault(pid, []).append((ts, v))
    for pid, items in by_pid.items():
        items.sort(key=lambda r: r[0])
        found: list[list] = []
        for ts, v in items:
            if not found or ts - found[-1][-1][0] > timedelta(seconds=gap):
                found.append([])
            found[-1].append((ts, v))
        last = []
        for i, s in enumerate(found):
            if i + 1 == len(found) or found[i + 1][-1][0] - s[-1][0] > timedelta(seconds=episode):
                last.append(s)
        for s in last:
            positive = [ts for ts, v in s if v is not None and v > 0]
            anchor = max(positive) if positive else s[-1][0]
            out |= {(pid, ts, v) for ts, v in s if anchor - timedelta(seconds=window) <= ts <= anchor}
    return out


def kept(spark, rows, gap=GAP, episode=EPISODE, window=WINDOW):
    settings = ReductionSettings(salt="s", gap_minutes=gap / 60, episode_gap_days=episode / 86_400, window_minutes=window / 60)
    found = reduction.closing_session_rows(series(spark, rows), settings, "pid", "ts", "v", "baby")
    return found.collect()


@pytest.mark.parametrize("step, n_sessions", [(299, 1), (300, 1), (300.000001, 2)])
def test_gap_is_strict(spark, step, n_sessions):
    rows = series(spark, [("a", at(0), 1.0), ("a", at(step), 1.0)])
    assert sessions.session_table(rows, "pid", "ts", GAP).count() == n_sessions


@pytest.mark.parametrize("extra, n_episodes", [(0, 1), (1, 2)])
def test_episode_gap_is_end_to_end_and_strict(spark, extra, n_episodes):
    rows = series(spark, [("a", at(0), 1.0), ("a", at(EPISODE + extra), 1.0)])
    assert sessions.count_episodes(rows, "pid", "ts", GAP, EPISODE).first()["n_episodes"] == n_episodes


def test_window_ends_are_inclusive_and_trailing_zeros_are_cut(spark):
    rows = [("a", at(s), 120.0) for s in range(0, 4000, 100)] + [("a", at(s), 0.0) for s in range(4000, 4500, 100)]
    times = sorted(r["ts"] for r in kept(spark, rows))
    assert times[0] == at(300) and times[-1] == at(3900)


def test_all_zero_signal_falls_back_to_session_end(spark):
    rows = [("a", at(s), 0.0) for s in range(0, 7200, 200)]
    times = sorted(r["ts"] for r in kept(spark, rows))
    assert times[-1] == at(7000) and times[0] == at(3400)


def test_null_patient_is_dropped_and_key_is_salted_digest(spark):
    rows = [(None, at(0), 1.0), ("a", at(0), 1.0), ("a", at(10), 1.0)]
    found = kept(spark, rows)
    assert {r["pid"] for r in found} == {"a"}
    digest = hashlib.sha256(b"s|a|2020-01-01 12:00:10").hexdigest()
    assert {r["baby"] for r in found} == {digest}


def test_salt_is_required(spark):
    with pytest.raises(ValueError):
        kept_settings = ReductionSettings(salt="")
        reduction.closing_session_rows(series(spark, [("a", at(0), 1.0)]), kept_settings, "pid", "ts", "v", "baby")


@pytest.mark.parametrize("seed", range(3))
def test_random_series_with_a_hot_key_match_the_definition(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        pid = "hot" if i % 3 == 0 else rng.choice("abcdefgh")
        rows.append((pid, at(rng.choice([rng.randrange(0, 40_000), rng.randrange(0, 400_000)]) - 100_000), float(rng.choice([0, 0, 130]))))
    found = {(r["pid"], r["ts"], r["v"]) for r in kept(spark, rows, gap=600, episode=50_000, window=1500)}
    assert found == brute(rows, gap=600, episode=50_000, window=1500)


def test_assign_sessions_shares_duplicates(spark):
    rows = series(spark, [("a", at(0), 1.0), ("a", at(400), 1.0), ("a", at(400), 2.0), ("a", at(500), 1.0)])
    found = sessions.assign_sessions(rows, "pid", "ts", GAP).orderBy("ts", "v").collect()
    assert [r["session_id"] for r in found] == [1, 2, 2, 2]


def test_previous_value_is_carried_over_cells(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("ab"), at(rng.randrange(-5000, 50_000)), float(i)) for i in range(600)]
    found = cells.with_previous(series(spark, rows), ["pid"], "ts", {"prev": "v"}, 700, tie=["v"]).collect()
    expected = {}
    for pid in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == pid), key=lambda r: (r[1], r[2]))
        for before, here in zip([None, *ordered], ordered):
            expected[(pid, here[2])] = before[2] if before else None
    assert {(r["pid"], r["v"]): r["prev"] for r in found} == expected


def test_running_totals_are_global(spark):
    rows = spark.createDataFrame([(i % 2, i, i * 7 % 101) for i in range(400)], "g int, id int, x int")
    found = cells.running_totals(
        rows, ["g"], F.floor(F.col("x") / 10), [F.col("x"), F.col("id")], {"s": F.lit(1)}
    ).collect()
    for g in (0, 1):
        ordered = sorted((r for r in found if r["g"] == g), key=lambda r: (r["x"], r["id"]))
        assert [r["s"] for r in ordered] == list(range(1, len(ordered) + 1))


def test_result_does_not_depend_on_shuffle_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), at(rng.randrange(0, 100_000)), 120.0) for _ in range(500)]
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, kept(spark, rows))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_streaming_sessions_agree_with_batch(spark, tmp_path):
    from vitalspan.streaming.sessions import stream_sessions

    rows = [("a", at(0)), ("a", at(300)), ("a", at(601)), ("b", at(50)), ("z", at(90_000))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "pid string, ts timestamp_ntz").write.parquet(source)
    stream = spark.readStream.schema("pid string, ts timestamp_ntz").parquet(source)
    closed = stream_sessions(stream, "pid", "ts", GAP, "1 minute")
    job = closed.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination(120)
    found = {(r["pid"], r["session_start"], r["session_end"], r["n_rows"]) for r in spark.table("closed").collect()}
    assert found == {("a", at(0), at(300), 2), ("a", at(601), at(601), 1), ("b", at(50), at(50), 1)}
