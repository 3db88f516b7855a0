from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from vitalspan.config import SplitSettings
from vitalspan.operators import features, metrics, splits
from vitalspan.operators.quantiles import exact_quantiles

PS = {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q00": 0.0, "q100": 1.0}


@pytest.mark.parametrize("kind", ["continuous", "ties", "tiny"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    frames = []
    for g, n in (("hot", 24_000), ("mid", 8001), ("few", 7), ("one", 1)):
        if kind == "tiny" and n > 10:
            continue
        x = rng.integers(0, 5, n).astype(float) if kind == "ties" else rng.normal(size=n)
        frames.append(pd.DataFrame({"g": g, "x": x}))
    data = pd.concat(frames)
    rows = spark.createDataFrame(data).union(spark.createDataFrame([("few", None)], "g string, x double"))
    found = {r["g"]: r for r in exact_quantiles(rows, ["g"], {k: ("x", p) for k, p in PS.items()}).collect()}
    for g, part in data.groupby("g"):
        for k, p in PS.items():
            assert found[g][k] == pytest.approx(np.quantile(part["x"], p), abs=1e-12), (g, k)


def test_features_match_pandas(spark):
    rng = random.Random(2)
    start = pd.Timestamp("2020-01-01")
    rows = []
    for baby, n in (("a", 500), ("b", 1), ("c", 40)):
        for i in range(n):
            rows.append((baby, start + pd.Timedelta(seconds=i * 7), float(rng.choice([0, 120, 130.5])), float(rng.randrange(50))))
    rows += [("z", start + pd.Timedelta(seconds=i), 0.0, 0.0) for i in range(3)]
    data = pd.DataFrame(rows, columns=["BabyID", "Timestamp", "FHR", "toco"])
    frame = spark.createDataFrame([(b, t.to_pydatetime(), f, o) for b, t, f, o in rows], "BabyID string, Timestamp timestamp_ntz, FHR double, toco double")
    found = {r["BabyID"]: r for r in features.aggregate_features(frame).collect()}
    bounded = features.aggregate_features(frame, bounded=True)
    assert bounded._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for r in bounded.collect():
        assert all(a == pytest.approx(b, nan_ok=True) for a, b in zip(r[1:], found[r["BabyID"]][1:], strict=True))
    for baby, p in data.groupby("BabyID"):
        r, pos = found[baby], p["FHR"][p["FHR"] > 0]
        expected = {
            "n_rows": len(p),
            "duration_seconds": (p["Timestamp"].max() - p["Timestamp"].min()).total_seconds(),
            "fhr_mean": p["FHR"].mean(), "fhr_std": p["FHR"].std(), "fhr_zero_frac": (p["FHR"] == 0).mean(),
            "fhr_nonzero_mean": pos.mean(), "fhr_nonzero_std": pos.std(), "fhr_q10": p["FHR"].quantile(0.1),
            "toco_q90": p["toco"].quantile(0.9), "toco_max": p["toco"].max(),
            "fhr_abs_diff_mean": p["FHR"].diff().abs().mean(), "toco_abs_diff_mean": p["toco"].diff().abs().mean(),
        }
        for name, value in expected.items():
            if pd.isna(value):
                assert r[name] is None, (baby, name)
            else:
                assert r[name] == pytest.approx(value), (baby, name)
    typed = features.as_model_types(features.aggregate_features(frame))
    assert dict(typed.dtypes)["n_rows"] == "int" and dict(typed.dtypes)["fhr_std"] == "float"


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def brute_ap(y, s):
    total, previous = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total, previous = total + (recall - previous) * precision, recall
    return total


def brute_best(y, s, points):
    best = (-1.0, 0.5)
    for t in points:
        hit = s >= t
        tp = int(y[hit].sum())
        denominator = int(hit.sum()) + int(y.sum())
        f1 = 2 * tp / denominator if denominator else 0.0
        if f1 > best[0]:
            best = (f1, float(t))
    return best


@pytest.mark.parametrize("n, digits", [(200, 1), (300, 6), (1500, 6)])
def test_metrics_match_brute_force(spark, n, digits):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 2, n)
    s = np.round(np.clip(rng.random(n) * 0.7 + 0.3 * y * rng.random(n), 0, 1), digits)
    rows = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    r = metrics.binary_metrics(rows, "y", "s", 0.4).first()
    assert r["roc_auc"] == pytest.approx(brute_auc(y, s))
    assert r["pr_auc"] == pytest.approx(brute_ap(y, s))
    hit = s >= 0.4
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (
        int(y[hit].sum()), int((1 - y)[hit].sum()), int(y[~hit].sum()), int((1 - y)[~hit].sum()))
    for kind, points in (("distinct", np.unique(s)), ("grid", np.linspace(0, 1, 501))):
        best = metrics.best_f1_threshold(rows, "y", "s", candidates=kind).first()
        f1, threshold = brute_best(y, s, points)
        assert best["f1"] == pytest.approx(f1) and best["threshold"] == pytest.approx(threshold)
    with pytest.raises(ValueError):
        metrics.best_f1_threshold(rows, "y", "s", candidates="some")


def test_areas_of_scores_outside_zero_and_one(spark):
    rng = np.random.default_rng(1)
    frames = []
    for task, (shift, scale) in enumerate([(0, 1), (5, 3), (-40, 0.001)]):
        y = rng.integers(0, 2, 400)
        frames.append(pd.DataFrame({"task": task, "y": y, "s": shift + scale * (rng.normal(size=400) + y)}))
    rows = spark.createDataFrame(pd.concat(frames))
    found = {r["task"]: r for r in metrics.binary_metrics(rows, "y", "s", group=["task"]).collect()}
    for task, frame in enumerate(frames):
        assert found[task]["roc_auc"] == pytest.approx(brute_auc(frame["y"].to_numpy(), frame["s"].to_numpy()))
        assert found[task]["pr_auc"] == pytest.approx(brute_ap(frame["y"].to_numpy(), frame["s"].to_numpy()))


def test_one_class_has_no_areas(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.9)], "y int, s double")
    r = metrics.binary_metrics(rows, "y", "s").first()
    assert r["roc_auc"] is None and r["pr_auc"] is None and r["f1"] == 0.0 and r["precision"] == 0.0
    assert metrics.best_f1_threshold(rows, "y", "s").first()["threshold"] == pytest.approx(0.1)


def test_split_is_stratified_repeatable_and_complete(spark):
    rows = spark.createDataFrame([(f"b{i}", int(i % 50 == 0)) for i in range(2000)], "BabyID string, target int")
    one = splits.stratified_split(rows, SplitSettings()).toPandas()
    two = splits.stratified_split(rows.repartition(7), SplitSettings()).toPandas()
    assert len(one) == 2000 and one["BabyID"].is_unique
    assert one.sort_values("BabyID").reset_index(drop=True).equals(two.sort_values("BabyID").reset_index(drop=True))
    assert one.groupby(["target", "split"]).size().to_dict() == {
        (0, "train"): 1372, (0, "val"): 294, (0, "test"): 294, (1, "train"): 28, (1, "val"): 6, (1, "test"): 6}
    other = splits.stratified_split(rows, SplitSettings(random_seed=1)).toPandas()
    assert not one.sort_values("BabyID")["split"].tolist() == other.sort_values("BabyID")["split"].tolist()


def test_fractions_must_sum_to_one():
    with pytest.raises(ValueError):
        SplitSettings(0.5, 0.3, 0.3)


def test_tempered_weights(spark):
    rows = spark.createDataFrame([(1,)] * 8 + [(2,)] * 2, "c int")
    found = {r["c"]: r["weight"] for r in metrics.tempered_class_weights(rows, "c", 0.5).collect()}
    raw = {1: (10 / 8) ** 0.5, 2: (10 / 2) ** 0.5}
    mean = sum(raw.values()) / 2
    assert found == pytest.approx({k: v / mean for k, v in raw.items()})



@pytest.mark.parametrize("n", [1, 2, 79, 80, 799, 800, 7999, 8000, 100_000])
def test_quantiles_of_groups_of_any_size_with_ties(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.gamma(2, 3, n), 1) * rng.integers(0, 2, n)
    rows = spark.createDataFrame(pd.DataFrame({"g": 1, "v": values}))
    probabilities = [0.0, 0.0003, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    found = exact_quantiles(rows, ["g"], {f"q{i}": ("v", p) for i, p in enumerate(probabilities)}).first()
    assert [found[f"q{i}"] for i in range(len(probabilities))] == pytest.approx(list(np.quantile(values, probabilities)))
