"""Primitives that keep exchanges small and even: key bitmaps, measured hot keys, ranges."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitalspan.catalog.parsing import RAW_REGISTRY
from vitalspan.operators import matching, metrics, prefilter, registry, sessions, skew


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bitmap_keeps_every_partner_and_few_others(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).cast("int").alias("k"), F.col("id").cast("string").alias("c"))
    keys = spark.range(0, 5000, 50).select(F.col("id").alias("k"))
    kept = prefilter.rows_that_may_match(rows, keys, ["k"])
    assert kept.where("k % 50 = 0").count() == 400
    assert kept.count() < 600
    # A bitmap far too small for the keys only keeps more; one without keys keeps nothing.
    full = prefilter.rows_that_may_match(rows, spark.range(5000).select(F.col("id").alias("k")), ["k"], bits=1 << 15)
    assert full.count() == 20_000
    assert prefilter.rows_that_may_match(rows, keys.limit(0), ["k"]).count() == 0
    two = spark.createDataFrame([(1, "1"), (2, "2"), (None, "3"), (4, None)], "k int, c string")
    assert prefilter.rows_that_may_match(rows, two, ["k", "c"]).where("k = 1 AND c = '1' OR k = 2 AND c = '2'").count() == 2


def test_rows_outside_all_windows_are_dropped_before_the_exchange(spark, no_broadcast):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(30), start + dt.timedelta(seconds=rng.randrange(40 * 86_400)), float(i % 7)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k long, ts timestamp_ntz, v double").repartition(4)
    windows = sessions.closing_windows(frame, "k", "ts", "v", 3600, 86_400 * 10, 1800)
    inside = sessions.rows_in_windows(frame, windows, "k", "ts", "window_start", "window_end", 1800)
    want = frame.join(windows, "k").where("ts BETWEEN window_start AND window_end")
    assert sorted(map(str, inside.select("k", "ts", "v").collect())) == sorted(map(str, want.select("k", "ts", "v").collect()))
    text = plan(inside)
    at = text.index("getbit")
    above = text[:at].splitlines()
    assert any("Exchange" in line for line in above) and "Filter" in text[text.rindex("\n", 0, at) : at]


def hot_frames(spark, hot: int):
    rows = spark.range(40_000).select(
        F.when(F.col("id") < hot, 0).otherwise(F.col("id") % 3000 + 1).cast("long").alias("k"), F.col("id").alias("n")
    )
    return rows, spark.range(0, 3001).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))


def test_only_hot_keys_are_repeated(spark):
    for hot, copies in ((0, 0), (20_000, 7)):
        rows, per_key = hot_frames(spark, hot)
        found = skew.hot_keys(rows.select(F.xxhash64("k").alias("_name"))).first()["hot"]
        assert len(found) == (hot > 0)
        joined = skew.join_per_key(rows, per_key, "k", ["n"], salts=8)
        assert joined.columns == ["k", "n", "w"]
        assert joined.where("w = 2 * k").count() == 40_000
        repeated = skew._repeated(rows, per_key, ["k"], 8)
        assert repeated.count() == 3001 + copies
    kept = skew.join_per_key(rows, per_key.where("k < 10").select("k"), "k", ["n"], how="left_semi")
    assert kept.columns == ["k", "n"] and kept.count() == rows.where("k < 10").count()
    assert skew.join_per_key(rows.limit(0), per_key, "k", ["n"]).count() == 0


def test_a_key_with_half_of_the_rows_is_spread(spark, no_broadcast):
    rows, per_key = hot_frames(spark, 20_000)
    rows = rows.repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = skew.join_per_key(rows, per_key, "k", ["n"], salts=8)
        used = joined.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used > 2


def test_score_ranges_follow_the_number_of_distinct_scores(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANGE_SCORES", 200)
    rows = spark.range(30_000).select(
        (F.col("id") % 2).alias("g"), (F.rand(3) < 0.3).cast("int").alias("y"), F.exp(-F.col("id") / 900).alias("s")
    )
    counts = metrics.score_counts(rows, ["g"], "y", "s")
    placed = metrics._with_ranges(counts)
    assert placed.columns == [*counts.columns, "_range"]
    per_range = placed.groupBy("_range").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))
    found = per_range.orderBy("_range").collect()
    assert 150 <= len(found) <= 260 and max(r["n"] for r in found) < 1000
    assert all(a["high"] <= b["low"] for a, b in zip(found, found[1:], strict=False))
    few = metrics._with_ranges(counts.where("score > 0.99"))
    assert few.select("_range").distinct().count() == 1
    assert metrics._with_ranges(counts.limit(0)).count() == 0


def test_scores_of_a_large_table_use_one_range_per_65536(spark):
    """591,475 distinct scores of the given tables take 16 ranges, none over a fifth of the scores."""
    folder = "/root/testdata/sf0.1"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("0 AS y", "l_extendedprice AS s")
    placed = metrics._with_ranges(metrics.score_counts(lines, [], "y", "s")).groupBy("_range").count().collect()
    total = sum(r["count"] for r in placed)
    assert total / metrics.RANGE_SCORES <= len(placed) <= 2 * total / metrics.RANGE_SCORES + 1
    assert max(r["count"] for r in placed) < total / 5


def test_matching_never_merges_partitions_by_compressed_bytes(spark, no_broadcast):
    """Merged partitions of narrow rows fill gigabytes in a sort buffer, so each exchange names its number."""
    rows = spark.range(600).selectExpr("id AS subject", "id % 200 AS person", "date_add(date'2024-01-01', int(id % 3)) AS day")
    born = "date_add(date'2024-01-01', int(id < 100)) AS birth_day"
    registry = spark.range(201).selectExpr("id AS r", "least(id, 199) AS person", born)
    recordings = matching.recording_map(skew.dealt(rows.union(rows), "subject"), "subject", "person", "day")
    args = (registry, recordings, "person", "birth_day", "subject", "day")
    found = {
        "day": matching.matches_per_day(*args),
        "row": matching.matches_per_row(*args),
        "unique": matching.unique_matches(*args, unique_on="subject"),
    }
    for df in found.values():
        text = plan(df)
        assert "ENSURE_REQUIREMENTS" not in text and "REPARTITION_BY_NUM" in text
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A person has recordings on three days; two of them fit the later birth day, one the earlier.
    assert found["day"].count() == 301 and found["row"].where("n_matches = 2").count() == 100
    # The registry rows 199 and 200 claim the same subject.
    assert sorted(r["r"] for r in found["unique"].collect()) == list(range(100, 199))


def test_registry_cells_are_not_parsed_below_the_exchange(spark):
    """A filter on parsed cells, pushed below, parses them twice and on the few splits of the file."""
    cells = {n: "CAST(NULL AS STRING)" for n in RAW_REGISTRY} | {
        "glopnr": "CAST(id AS STRING)",
        "personnummer_mor": "IF(id = 1, NULL, IF(id = 2, '1980', '19800102-1234'))",
        "forlossningsdatum_fv1": "IF(id = 3, '2021-02-30', '2021-02-03')",
        "apgar_5_min": "IF(id = 4, ' ', '9,0')",
        "moderns_diagnoser_rad": "IF(id = 5, 'o14-1 , O24', IF(id = 6, 'XO14,o140', NULL))",
        "tobak_inskrivning": "IF(id = 5, '1 CIGG/dag', NULL)",
        "intubation_min": "IF(id = 5, '1', ' ')",
    }
    raw = spark.range(7).repartition(2).selectExpr(*[f"{e} AS `{n}`" for n, e in cells.items()])
    people = registry.parse_registry(raw)
    text = people._jdf.queryExecution().optimizedPlan().toString()
    assert "2021-02-30" not in text[text.index("Repartition") :]
    found = {r["glopnr"]: (r["preeclampsia"], r["gestational_or_pregestational_diabetes"], r["is_smoker"], r["resuscitated"]) for r in people.collect()}
    assert found == {"0": (False,) * 4, "5": (False, True, True, True), "6": (True, False, False, False)}
