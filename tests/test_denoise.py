from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalspan.operators import denoise
from vitalspan.plans import patients
from vitalspan.sources import tables

T0 = datetime(2020, 1, 1)


def brute(frame: pd.DataFrame, step: float, points: int):
    """The cleaning steps written out on one subject."""
    f = frame.groupby("ts", as_index=False)["v"].mean()
    bad = f["v"].isna() | (f["v"] < 30) | (f["v"] > 240)
    if bad.all():
        return None
    end = f.loc[~bad, "ts"].max()
    v = np.full(points, np.nan)
    for ts, value in zip(f["ts"], f["v"]):
        back = (end - ts).total_seconds() / step
        if back == int(back) and 0 <= back < points:
            v[points - 1 - int(back)] = value
    out = np.isnan(v) | (v < 30) | (v > 240)
    half = max(3, 2 * round(2 / step) + 1) // 2
    use = np.where(out, np.nan, v)

    def med(x):
        return np.array([np.median(x[i - half : i + half + 1]) if half <= i < points - half else np.nan for i in range(points)])

    dev = np.abs(use - med(use))
    with np.errstate(invalid="ignore"):
        out = out | (dev > 3 * 1.4826 * med(dev))
        jump = np.abs(np.diff(v)) > 20
    out = out | (np.r_[False, jump] & np.r_[jump, False])
    known, limit = np.where(~out)[0], max(1, round(2 / step))
    for i in np.where(out)[0]:
        left, right = known[known < i], known[known > i]
        if len(left) and len(right) and i - left[-1] <= limit:
            a, b = left[-1], right[0]
            v[i] = v[a] + (v[b] - v[a]) * (i - a) / (b - a)
            out[i] = False
    est, var, smooth = None, 1.0, []
    for value, flag in zip(v, out):
        if est is None:
            est = None if flag else value
        else:
            var += 1.0
            if not flag:
                gain = var / (var + 4.0)
                est, var = est + gain * (value - est), (1 - gain) * var
        smooth.append(np.nan if flag else est)
    return np.array(smooth), out


@pytest.mark.parametrize("step, points", [(1.0, 120), (0.25, 200)])
def test_denoise_matches_written_out_steps(spark, step, points):
    rng = random.Random(9)
    rows = []
    for key in ("a", "b", "c"):
        level = 130.0
        for i in range(int(points * 1.2)):
            level += rng.uniform(-3, 3)
            if rng.random() < 0.15 or 40 < i < 48:
                continue
            value = rng.choice([0.0, 300.0, None, level + 60]) if rng.random() < 0.1 else level
            rows.append((key, T0 + timedelta(seconds=i * step), value))
            if rng.random() < 0.05:
                rows.append((key, T0 + timedelta(seconds=i * step), level))
            if rng.random() < 0.05:
                rows.append((key, T0 + timedelta(seconds=i * step + step / 3), level))
    rows.append(("none", T0, 0.0))
    data = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    found = denoise.denoise(data, "k", "ts", "v", step_seconds=step, points=points, min_share=0.1).toPandas()
    frame = pd.DataFrame(rows, columns=["k", "ts", "v"])
    assert set(found["k"]) == {"a", "b", "c"}
    for key in ("a", "b", "c"):
        mine = found[found["k"] == key].sort_values("position")
        smooth, out = brute(frame[frame["k"] == key], step, points)
        assert len(mine) == points
        assert mine["filtered"].to_numpy().tolist() == out.tolist()
        np.testing.assert_allclose(mine["v"].to_numpy(dtype=float), smooth, rtol=1e-9, equal_nan=True)


def test_completeness_limit(spark):
    rows = [("half", T0 + timedelta(seconds=i), 130.0 if i % 20 >= 10 else 0.0) for i in range(100)]
    data = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    grid = denoise.grid_align(data, "k", "ts", "v", 1.0, 100)
    assert denoise.keep_complete(grid, "k", 0.5).count() == 100
    assert denoise.keep_complete(grid, "k", 0.51).count() == 0


def raw_second(pid, ts, fhr=140, toco="AQIDBA=="):
    return (pid, ts, fhr, fhr, fhr, None, toco)


RAW = "PatientID string, Timestamp timestamp_ntz, Hr1_0 smallint, Hr1_1 smallint, Hr1_2 smallint, Hr1_3 smallint, Toco_Values string"


def test_sample_series(spark):
    raw = spark.createDataFrame([("p", T0, 100, 110, None, 0, "AQIDBA=="), ("p", None, 1, 1, 1, 1, None)], RAW)
    four = patients.signal_series(raw, 4).orderBy("Timestamp").collect()
    assert [(r["FHR"], r["toco"]) for r in four] == [(100.0, 1.0), (110.0, 2.0), (None, 3.0), (0.0, 4.0)]
    assert [r["Timestamp"].microsecond for r in four] == [0, 250_000, 500_000, 750_000]
    assert patients.signal_series(raw, 1).first()["FHR"] == 70.0
    assert patients.signal_series(raw, 1, "first").first()["FHR"] == 100.0


def test_process_patients_in_batches(spark, tmp_path):
    lines = ["personnummer_mor;forlossningsdatum_fv1;apgar_5_min"]
    lines += [f"19800101{i:04d};2020-01-02;{'' if i == 1 else '9,0'}" for i in range(5)]
    (tmp_path / "reg.csv").write_text("\n".join(lines), encoding="utf-8")
    rows = []
    for i in range(4):
        start = datetime(2020, 1, 1, 23, 0) if i != 3 else datetime(2020, 1, 5)
        rows += [raw_second(f"19800101-{i:04d}", start + timedelta(seconds=s)) for s in range(3600)]
    raw = spark.createDataFrame(rows, RAW)
    out = str(tmp_path / "out")
    patients.process_patients(spark, str(tmp_path / "reg.csv"), raw, out, start=1, count=2)
    patients.process_patients(spark, str(tmp_path / "reg.csv"), raw, out, start=3, count=10)
    meta = spark.read.parquet(f"{out}/metadata").orderBy("BabyID").collect()
    assert [(r["BabyID"], r["birth_day"], r["apgar5"]) for r in meta] == [(1, date(2020, 1, 2), 9), (2, date(2020, 1, 2), 9)]
    counts = spark.read.parquet(f"{out}/series").groupBy("BabyID").agg(F.count("*").alias("n"), F.avg("FHR").alias("m")).collect()
    assert {(r["BabyID"], r["n"], r["m"]) for r in counts} == {(1, 3600, 140.0), (2, 3600, 140.0)}


def test_row_numbers_follow_the_file(spark, tmp_path):
    lines = ["a,b", *[f"{i},x" for i in range(500)]]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    found = patients.numbered_rows(tables.read_any_csv(spark, str(tmp_path / "t.csv"))).collect()
    assert sorted((int(r["a"]), r["row_number"]) for r in found) == [(i, i + 1) for i in range(500)]
    with pytest.raises(ValueError):
        patients.patient_list(spark.createDataFrame([], "personnummer_mor string, forlossningsdatum_fv1 string, apgar_5_min string"), 0)


def test_daily_partitions(spark, tmp_path):
    raw = spark.createDataFrame([raw_second("19800101-0300", T0), raw_second("bad", T0), raw_second("19800101-0001", datetime(2010, 1, 1))], RAW)
    patients.partition_by_day(raw, str(tmp_path / "p"), "2014-12-31", ["PatientID", "Timestamp"])
    found = spark.read.parquet(str(tmp_path / "p")).collect()
    assert {(r["PatientID"], r["patient_bucket"], str(r["ctg_date"])) for r in found} == {("19800101-0300", 44, "2020-01-01"), ("bad", -1, "2020-01-01")}


def test_value_folders(spark, tmp_path):
    frame = spark.createDataFrame([(1,)], "x int")
    frame.write.parquet(str(tmp_path / "v" / "2020-01-02" / "7"))
    frame.write.parquet(str(tmp_path / "v" / "2020-01-03" / "8"))
    found = tables.read_value_folders(spark, str(tmp_path / "v"), ["ctg_date", "patient_bucket"]).collect()
    assert {tuple(r) for r in found} == {(1, "2020-01-02", "7"), (1, "2020-01-03", "8")}
