from __future__ import annotations

import base64
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vitalspan import schema
from vitalspan.config import ReductionSettings
from vitalspan.operators import dedup, quality
from vitalspan.plans import cohort, matching, reduction
from vitalspan.sources import tables

T0 = datetime(2021, 5, 1, 23, 30)
DERIVED = "Timestamp timestamp_ntz, PatientID string, RegistrationID bigint, FHR float, toco float, Hr1_SignalQuality string, Hr1Mode string, TocoMode string"


def closing(spark, rows):
    full = [(b, "p", t, f, o, q, None, "x") for b, t, f, o, q in rows]
    kinds = "BabyID string, PatientID string, Timestamp timestamp_ntz, FHR float, toco float, Hr1_SignalQuality string, Hr1Mode string, TocoMode string"
    return spark.createDataFrame(full, kinds)


def second(i):
    return T0 + timedelta(seconds=i)


def test_duplicate_rate_limit_is_inclusive(spark):
    rows = [("keep", second(i), 1.0, 1.0, "G") for i in range(10)] + [("keep", second(i), 1.0, 1.0, "G") for i in range(3)]
    rows += [("drop", second(i), 1.0, 1.0, "G") for i in range(10)] + [("drop", second(i), 1.0, 1.0, "G") for i in range(4)]
    kept = dedup.drop_noisy_keys(closing(spark, rows), "BabyID", "Timestamp", 0.30)
    assert {r["BabyID"] for r in kept.select("BabyID").distinct().collect()} == {"keep"}
    assert kept.count() == 13


def test_vote(spark):
    rows = [
        ("a", second(0), 100.0, 0.0, "G"), ("a", second(0), 110.0, 100.0, "R"), ("a", second(0), 0.0, 50.0, "R"), ("a", second(0), 121.0, 60.0, None),
        ("a", second(1), 0.0, 0.0, "Y"), ("a", second(1), 0.0, 120.0, "G"),
        ("a", second(2), 5.0, 5.0, None), ("a", second(2), 6.0, 5.0, None),
    ]
    voted = reduction.remove_duplicates(closing(spark, rows), 1.0).orderBy("Timestamp").collect()
    assert [(r["FHR"], r["toco"], r["Hr1_SignalQuality"]) for r in voted] == [
        (110.0, 55.0, "R"), (0.0, 60.0, "G"), (5.5, 5.0, None)]
    assert [r["Hr1Mode"] for r in voted] == [None] * 3 and voted[0]["PatientID"] == "p"


@pytest.mark.parametrize("n, kept", [(1199, 0), (1200, 1)])
def test_quality_limit(spark, n, kept):
    rows = [("a", second(i), 1.0 if i < n else 0.0, 1.0, "G") for i in range(1300)]
    found = reduction.keep_informative(closing(spark, rows), 1200)
    assert found.select("BabyID").distinct().count() == kept


def test_anchor_date_and_uniqueness(spark):
    rows = [("a", second(0), 1.0, 1.0, "G"), ("a", second(3000), 1.0, 1.0, "G")]
    dated = reduction.add_anchor_date(closing(spark, rows))
    assert {str(r["ctg_date"]) for r in dated.collect()} == {"2021-05-02"}
    checked = quality.require_unique(dated, "BabyID")
    with pytest.raises(Exception, match="duplicate BabyID"):
        checked.collect()
    assert quality.require_unique(dated.limit(1), "BabyID").columns == dated.columns
    with pytest.raises(ValueError):
        ReductionSettings(salt="s", gap_minutes=0)


def raw_rows(seed=0):
    rng = random.Random(seed)
    rows = []
    for p in range(6):
        pid = f"19800101-{p:04d}"
        begin = datetime(2021, 1, 1 + p, 22, 50)
        for i in range(2400):
            if rng.random() < 0.02:
                continue
            for _ in range(2 if rng.random() < (0.5 if p == 5 else 0.1) else 1):
                fhr = [rng.choice([0, 140, 141, None]) for _ in range(4)] if p != 4 else [0, 0, 0, 0]
                toco = base64.b64encode(bytes(rng.randrange(0, 130) for _ in range(4))).decode()
                rows.append((pid, p, begin + timedelta(seconds=i), "US", None, None, "T", toco, *fhr, rng.choice("GYR"), *[None] * 10))
    rows.append((None, 9, datetime(2021, 1, 1), *[None] * 20))
    rows.append(("19800101-0000", 9, datetime(2013, 1, 1), *[None] * 20))
    return rows


SETTINGS = ReductionSettings(salt="pepper", min_positive_seconds=1000)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    raw = spark.createDataFrame(raw_rows(), schema.RAW_FLAT)
    half = F.col("RegistrationID") < 3
    raw.where(half).coalesce(1).write.parquet(f"{root}/raw/one")
    drifted = raw.where(~half).drop("TocoMode").withColumns({f"Hr1_{i}": F.col(f"Hr1_{i}").cast("int") for i in range(4)})
    drifted.coalesce(1).write.parquet(f"{root}/raw/two")
    stages = reduction.StagedReduction(spark, f"{root}/out", SETTINGS)
    stages.run_all(f"{root}/raw")
    return stages


def test_stages_agree_with_the_single_job(spark, staged):
    raw = tables.read_unified_parquet(spark, tables.parquet_files(spark, staged.root.replace("/out", "/raw")))
    series = reduction.derive_signals(reduction.time_filter(raw, SETTINGS.cutoff))
    one = reduction.reduce_series(series, SETTINGS)
    stored = spark.read.parquet(staged.path("stage5_5")).select(one.columns)
    assert one.count() == stored.count() > 0
    assert one.exceptAll(stored).count() == 0
    assert one.groupBy("BabyID", "Timestamp").count().where("count > 1").count() == 0
    assert {r["PatientID"] for r in one.select("PatientID").distinct().collect()} == {f"19800101-{p:04d}" for p in range(4)}


def test_stages_only_shrink_and_have_their_layout(spark, staged):
    counts = [staged.read(s).count() for s in ("stage1", "stage2", "stage3", "stage4", "stage5", "stage5_5", "stage6")]
    assert counts[0] == counts[1] and all(a >= b for a, b in zip(counts, counts[1:])) and counts[-1] == counts[-3] > 0
    for stage, layout in (("stage2", schema.DERIVED), ("stage3", schema.CLOSING), ("stage4", schema.VOTED), ("stage5_5", schema.DATED)):
        found = staged.read(stage).schema
        assert [(f.name, f.dataType) for f in found.fields] == [(f.name, f.dataType) for f in layout.fields], stage


def test_bucket_runs_add_up(spark, staged):
    series = staged.read("stage2")
    whole = reduction.closing_session_rows(series, SETTINGS)
    parts = [reduction.closing_session_rows(series, SETTINGS, bucket=(4, i)) for i in range(4)]
    assert sum(p.count() for p in parts) == whole.count()


REGISTRY = {c: None for c in """glopnr personnummer_mor forlossningsdatum_fv1 forlossningstid_fv1 etablerade_varkar_datum etablerade_varkar_tid
forlossningsstart_basta_skattning forlossningsslut_basta_skattning apgar_1_min apgar_5_min apgar_10_min gl_v_barn gl_d_barn fodelseland
utbildningsniva para_mhv1 langd_inskrivning_cm bmi_inskrivning tidigare_sectio tobak_3_manader_fore_graviditet tobak_inskrivning
tobak_vecka_30_32 diabetes_mellitus kon alkohol_audit_poang ph_navelartar ph_navelven avled_datum moderns_diagnoser_rad
moderns_atgarder_rad barnets_diagnoser_rad barnets_atgarder_rad ventilation_pa_mask_min intubation_min hjartmassage_min""".split()}


def write_csv(path, rows, sep):
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(rows).to_csv(path, sep=sep, index=False)


def test_matching_end_to_end(spark, staged, tmp_path):
    def person(p, **more):
        birth = {0: "2021-01-01", 1: "2021-01-03", 2: "2021-01-05", 3: "2021-01-04"}[p]
        base = {"glopnr": f"{p}.0", "personnummer_mor": f"19800101{p:04d}", "forlossningsdatum_fv1": birth, "apgar_5_min": "9"}
        return {**REGISTRY, **base, **more}

    rows = [person(0, apgar_5_min="6", kon="Flicka"), person(1), person(1, kon="Pojke"), person(2), person(3, apgar_5_min="")]
    write_csv(tmp_path / "reg.csv", rows, ";")
    neo = [{"glopnr": "0", "Högst HIE": "1", "HIE": "Nej", "ICD_kod": "P90;X1", "KVÅ_kod": None},
           {"glopnr": "0.0", "Högst HIE": "2", "HIE": "Ja", "ICD_kod": None, "KVÅ_kod": "DG021"}]
    write_csv(tmp_path / "neo.csv", neo, ",")
    counts = matching.run_matching(
        spark, str(tmp_path / "reg.csv"), str(tmp_path / "neo.csv"), staged.path("stage5_5"), staged.path("stage6"),
        str(tmp_path / "registry"), str(tmp_path / "series"),
    )
    assert (counts.total_rows, counts.usable_rows, counts.matched_rows, counts.ambiguous_rows) == (5, 4, 3, 0)
    exported = spark.read.option("header", True).csv(str(tmp_path / "registry")).toPandas()
    assert len(exported) == 3 and exported["BabyID"].nunique() == 2 and len(exported.columns) == 55
    girl = exported[exported["child_sex"] == "Flicka"].iloc[0]
    assert (girl["highest_hie"], girl["hie"], girl["neonatal_convulsions"], girl["respiratorbehandling"]) == ("2", "true", "true", "true")
    final = spark.read.parquet(str(tmp_path / "series"))
    assert final.columns == [f.name for f in schema.FINAL_SERIES.fields]
    assert final.select("BabyID").distinct().count() == 2

    report = {r["stage"]: r for r in cohort.cohort_report(spark, str(tmp_path / "reg.csv"), {
        "stage2": staged.path("stage2"), "stage5_5": staged.path("stage5_5"), "none": str(tmp_path / "none")}).collect()}
    assert report["stage2"]["pregnancies"] == 6 and report["stage2"]["babies"] is None
    assert report["stage5_5"]["babies"] == report["stage5_5"]["pregnancies"] == 4
    assert report["stage5_5"]["registry_overlap_patients"] == 4 and report["none"]["files"] == 0

    picked = cohort.pick_subject(final, 3, spark.read.option("header", True).csv(str(tmp_path / "registry")), 6).first()["BabyID"]
    assert picked == girl["BabyID"]
    assert cohort.trace(final, picked, 10).count() <= 601


def test_bad_inputs_fail_loudly(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.parquet_files(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        tables.read_side_registry(spark, "x.ods")
    assert tables.likely_separator(["a;b;c", "1;2,5;3"]) == ";" and tables.likely_separator(["a,b", "1,2"]) == ","


def test_inspect_raw(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), (None, 3)], "PatientID string, RegistrationID int")
    r = cohort.inspect_raw(rows).first()
    assert (r["n_rows"], r["n_patients"], r["n_registrations"], r["n_conflicts"]) == (4, 2, 3, 1)
