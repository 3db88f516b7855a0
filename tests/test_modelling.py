from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalspan import config
from vitalspan.operators import evaluation, sequences, splits, tabular
from vitalspan.plans import modelling, study

T0 = datetime(2020, 1, 1)
JOB_FAILED = (PySparkException, Py4JJavaError)
SERIES = "BabyID string, Timestamp timestamp_ntz, FHR float, toco float, Hr1_SignalQuality string"


def series(spark, lengths):
    rng = random.Random(4)
    rows = []
    for baby, n in lengths.items():
        for i in range(n):
            rows.append((baby, T0 + timedelta(seconds=i), rng.choice([0.0, 120.0 + i, float("nan")]), rng.choice([0.0, 5.0]), rng.choice(["G", "Y", "R", None])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SERIES), pd.DataFrame(rows, columns=["b", "t", "f", "o", "q"])


STEPS = config.SequenceSettings(window_minutes=1, include_signal_quality_channels=True)


def test_sequences(spark):
    frame, data = series(spark, {"long": 150, "exact": 60, "short": 7})
    found = {r["BabyID"]: r for r in sequences.model_sequences(frame, STEPS).collect()}
    assert set(found) == {"long", "exact", "short"}
    for baby, part in data.groupby("b"):
        part, r = part.sort_values("t").tail(60), found[baby]
        pad = 60 - len(part)
        f = part["f"].to_numpy(dtype=float)
        missing = ~np.isfinite(f) | (f == 0)
        np.testing.assert_allclose(np.array(r["FHR"])[pad:], np.where(missing, np.nan, f), equal_nan=True)
        assert np.isnan(np.array(r["FHR"])[:pad]).all() and len(r["FHR"]) == 60
        assert r["fhr_missing_mask"] == [1.0] * pad + missing.astype(float).tolist()
        assert r["padding_mask"] == [1.0] * pad + [0.0] * len(part)
        assert r["Hr1_SignalQuality==Y"] == [0.0] * pad + (part["q"] == "Y").astype(float).tolist()
    assert found["long"]["raw_len"] == 150
    kept = sequences.model_sequences(frame, config.SequenceSettings(window_minutes=1, pad_short=False))
    assert {r["BabyID"] for r in kept.collect()} == {"long", "exact"}


def test_channel_scaling(spark):
    frame, _ = series(spark, {"a": 80, "b": 30})
    built = sequences.model_sequences(frame, STEPS)
    m = sequences.signal_moments(built, ["FHR", "toco"]).first()
    values = np.concatenate([np.array(r["FHR"], dtype=float) for r in built.collect()])
    values = values[np.isfinite(values)]
    assert m["FHR_mean"] == pytest.approx(values.mean()) and m["FHR_std"] == pytest.approx(values.std())
    assert (m["toco_mean"], m["toco_std"]) == (5.0, 1.0)
    scaled = sequences.normalise_channels(built, {"FHR": (m["FHR_mean"], m["FHR_std"])}, ["padding_mask"], 1.0)
    flat = np.concatenate([np.array(r["FHR"]) for r in scaled.collect()])
    assert np.isfinite(flat).all() and abs(flat.mean()) < 1e-5


def test_encoder_levels_and_masks(spark):
    rows = [(i, float(i) if i % 2 else None, [True, False, None][i % 3], ["common"] * 5 + ["rare"], f"c{min(i % 7, 3)}" if i % 4 else None) for i in range(100)]
    data = [(i, x, b, levels[i % 6] if i % 10 else None, c) for i, x, b, levels, c in rows]
    frame = spark.createDataFrame(data, "id int, x double, b boolean, lv string, country string")
    encoder = tabular.fit_encoder(frame, ["x"], ["b"], ["lv", "country"], ["country"], top_k=2, min_frequency=50)
    p = pd.DataFrame(data, columns=["id", "x", "b", "lv", "country"])
    assert encoder.medians["x"] == p["x"].median()
    assert encoder.levels["lv"] == ["common"]
    counts = p["country"].fillna("__MISSING__").value_counts()
    assert set(encoder.levels["country"]) == set(counts.index[:2]) - {"__MISSING__"}
    e = tabular.encode(frame, encoder, ["id"]).toPandas().sort_values("id").reset_index(drop=True)
    assert list(e.columns) == ["id", *encoder.feature_names]
    assert (e["lv__missing"] + e["lv==common"] + e["lv__other"] == 1).all()
    assert e["x"].tolist() == p["x"].fillna(p["x"].median()).tolist() and e["b__missing"].sum() == p["b"].isna().sum()
    moments = tabular.feature_moments(tabular.encode(frame, encoder, ["id"]), encoder.scaled_names)
    assert moments["x"] == pytest.approx((e["x"].mean(), e["x"].std(ddof=0)))
    all_null = frame.withColumn("x", F.lit(None).cast("double"))
    assert tabular.fit_encoder(all_null, ["x"], [], []).medians == {"x": 0.0}


def test_targets(spark):
    rows = spark.createDataFrame([(1, 11.0, "B", 7.1, True), (2, -1.0, "Z", None, None), (3, None, None, None, False)], "id int, s double, c string, n double, f boolean")
    found = tabular.targets(rows, ["id"], ["s"], {"c": ["A", "B"]}, ["n"], ["f"], ["f"]).orderBy("id").collect()
    assert [(r["y_s"], r["mask_s"], r["y_c"], r["mask_c"], r["y_f"], r["mask_f"]) for r in found] == [
        (10, 1.0, 1, 1.0, 1.0, 1.0), (0, 1.0, 0, 0.0, 0.0, 1.0), (0, 0.0, 0, 0.0, 0.0, 1.0)]


def registry_frame(spark, n=160):
    reg = config.RegistrySettings()
    rng = random.Random(8)
    rows = []
    for i in range(n):
        row = {"BabyID": f"b{i:03d}"}
        row |= {c: rng.choice(["", "1.5", str(rng.randrange(200)), None]) for c in reg.input_numeric}
        row |= {c: rng.choice(["true", "false", None]) for c in (*reg.input_boolean, *reg.binary_outputs)}
        row |= {c: rng.choice(["A", " B ", "nan", None]) for c in (*reg.input_categorical, *reg.categorical_outputs)}
        row |= {c: str(rng.randrange(11)) for c in reg.apgar_outputs} | {c: "7.1" for c in reg.continuous_outputs}
        row["langd_inskrivning_cm"] = rng.choice(["0", "170"])
        rows.append(row)
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} string" for c in names))


def test_multimodal_tables(spark):
    registry = registry_frame(spark)
    reg = config.RegistrySettings(categorical_other_min_frequency=20)
    cleaned = tabular.clean_inputs(registry, reg)
    assert cleaned.where("langd_inskrivning_cm <= 0").count() == 0
    labelled = splits.labels(registry, 6)
    made = splits.stratified_split(labelled, config.SplitSettings())
    frame, _ = series(spark, {f"b{i:03d}": 5 for i in range(160)})
    settings = config.StudySettings(sequence=STEPS, registry=reg)
    built = modelling.multimodal_tables(frame, registry, made, settings)
    assert built.count() == 160
    row = built.first().asDict()
    assert {"FHR", "toco", "y_apgar5", "mask_ph_navel_below7", "maternal_age", "forlossningsstart==A"} <= set(row)
    assert row["mask_respiratorbehandling"] == 1.0
    stacked = modelling.sequence_tables(frame, made, settings)
    assert stacked.count() == 160 and {"target", "split", "padding_mask"} <= set(stacked.columns)
    # Both are found when the rows are read, not when the frame is made.
    with pytest.raises(JOB_FAILED, match="duplicate BabyID rows: b000"):
        tabular.clean_inputs(registry.union(registry), reg).collect()
    with pytest.raises(JOB_FAILED, match="duplicate BabyID"):
        tabular.merge_splits(made.union(made), cleaned).collect()
    with pytest.raises(JOB_FAILED, match="no series for subject b001"):
        modelling.baseline_dataset(made, frame.where("BabyID <> 'b001'")).collect()
    with_leak = config.RegistrySettings(input_excluded_due_to_leakage=("maternal_age", "is_girl"))
    assert not {"maternal_age", "is_girl"} & {*with_leak.input_numeric, *with_leak.input_boolean}
    assert "maternal_age" not in modelling.multimodal_tables(frame, registry, made, config.StudySettings(sequence=STEPS, registry=with_leak)).columns


def newton(x, y, w, penalty):
    """Reference solution of the penalised weighted logistic loss."""
    design = np.c_[np.ones(len(x)), x]
    beta = np.zeros(design.shape[1])
    ridge = np.r_[0.0, np.full(x.shape[1], penalty)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (w * (p - y)) + ridge * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        beta -= np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-design @ beta))


def test_baseline_matches_newton(spark):
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=(n, 2)) * [5, 0.1] + [100, 0]
    y = (x[:, 0] - 100 + rng.normal(size=n) * 6 > 6).astype(int)
    data = pd.DataFrame({"BabyID": [f"b{i}" for i in range(n)], "target": y, "apgar5": 9, "f1": x[:, 0], "f2": x[:, 1]})
    data["split"] = np.where(np.arange(n) < 280, "train", np.where(np.arange(n) < 340, "val", "test"))
    data.loc[::9, "f2"] = np.nan
    frame = spark.createDataFrame(data)
    model, report = modelling.run_baseline(frame)
    train = data[data["split"] == "train"]
    filled = data[["f1", "f2"]].fillna(train[["f1", "f2"]].median())
    mean, std = filled[data["split"] == "train"].mean(), filled[data["split"] == "train"].std(ddof=0)
    z = ((filled - mean) / std).to_numpy()[: len(train)]
    yt = train["target"].to_numpy()
    w = np.where(yt == 1, len(yt) / (2 * yt.sum()), len(yt) / (2 * (1 - yt).sum()))
    expected = newton(z, yt, w, 1.0)
    scored = model.score(frame.where("split = 'train'"), ["BabyID"]).toPandas().set_index("BabyID")
    np.testing.assert_allclose(scored.loc[train["BabyID"], "score"], expected, atol=1e-4)
    lines = {r["split"]: r for r in report.collect()}
    assert set(lines) == {"val", "test_val_tuned", "test_default_0.5"} and lines["val"]["roc_auc"] > 0.7
    assert lines["val"]["threshold"] == lines["test_val_tuned"]["threshold"]


def test_evaluation_and_study(spark, tmp_path):
    rng = np.random.default_rng(6)
    logits = rng.normal(size=(50, 11))
    truth = [int(t) if i % 5 else None for i, t in enumerate(rng.integers(0, 11, 50))]
    rows = spark.createDataFrame([(logits[i].tolist(), truth[i]) for i in range(50)], "lg array<double>, t int")
    found = {(r["task"], r["metric"]): r["value"] for r in evaluation.evaluate(rows, evaluation.EvaluationSpec(scores=[evaluation.TaskColumns("a", "t", "lg")])).collect()}
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    keep = [i for i in range(50) if truth[i] is not None]
    error = (p @ np.arange(11))[keep] - np.array([truth[i] for i in keep])
    assert found[("a", "mae")] == pytest.approx(np.abs(error).mean()) and found[("a", "rmse")] == pytest.approx(np.sqrt((error**2).mean()))
    assert found[("a_below7", "prevalence")] == pytest.approx(np.mean([truth[i] < 7 for i in keep]))

    runs = [(s, a, o, m, 0.8 - 0.01 * s - (0.1 if a == "CTG" else 0)) for s in (1, 2) for a in ("baseline", "CTG") for o in study.SCORE_OUTCOMES for m in study.METRICS]
    frame = spark.createDataFrame(runs, "seed int, ablation string, outcome string, metric string, value double")
    specs = study.removals("grouped", config.RegistrySettings(), only=["CTG"])
    assert [s.name for s in specs] == ["baseline", "CTG"]
    study.write_study(spark, frame, str(tmp_path), study.SCORE_OUTCOMES, specs)
    summary = spark.read.option("header", True).csv(str(tmp_path / "summary")).where("ablation = 'CTG'").first()
    assert float(summary["apgar_mean_below7_mean_drop_roc_auc"]) == pytest.approx(0.1)
    assert float(summary["apgar5_below7_sd_drop_pr_auc"]) == pytest.approx(0.0, abs=1e-12)
    with pytest.raises(ValueError):
        study.removals("single", config.RegistrySettings(), only=["nope"])
    assert len(study.removals("both", config.RegistrySettings())) == 3 + 4 + 21


def test_removed_inputs(spark):
    names = ["age", "age__missing", "kind__missing", "kind==A", "kind__other", "kind2"]
    assert evaluation.features_of(names, ["kind"]) == ["kind__missing", "kind==A", "kind__other"]
    rows = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0, 0.0, 5.0, [1.0, 2.0])], ", ".join(f"`{n}` double" for n in names) + ", FHR array<float>")
    means = {n: 9.0 for n in names}
    group = study.apply_removal(rows, study.Removal("k", inputs=("kind",)), names, ["FHR"], means).first()
    assert list(group)[:6] == [1.0, 0.0, 9.0, 9.0, 9.0, 5.0]
    assert study.apply_removal(rows, study.Removal("s", series=True), names, ["FHR"], means).first()["FHR"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        evaluation.remove_features(rows, names, ["zzz"], means)


def test_settings_from_toml(tmp_path):
    path = tmp_path / "s.toml"
    path.write_text('[paths]\nregistry_csv = "r"\n[split]\ntrain_fraction = 0.8\nval_fraction = 0.1\ntest_fraction = 0.1\nrandom_seed = 1\n[sequence]\nwindow_minutes = 20\nquality_levels = ["R"]\n')
    s = config.load_settings(path)
    assert s.split.train_fraction == 0.8 and s.sequence.n_steps == 1200 and s.sequence.quality_levels == ("R",) and s.paths["registry_csv"] == "r"
    path.write_text("[split]\ntrain_fraction = 0.8\nval_fraction = 0.3\ntest_fraction = 0.1\n")
    with pytest.raises(ValueError):
        config.load_settings(path)
