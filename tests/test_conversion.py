from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vitalspan import schema
from vitalspan.plans import conversion
from vitalspan.sources import concat_json


def record(i, **more):
    base = {
        "PatientID": f"19800101-{i:04d}",
        "RegistrationID": i,
        "Timestamp": f"7/24/2021 1:16:{i % 60:02d} PM",
        "Hr1Mode": "US",
        "Hr1": {"Values": [140, 141, 0, i % 200], "SignalQuality": "G"},
        "Toco": {"Values": "AAECAw=="},
    }
    return json.dumps({**base, **more}, ensure_ascii=False)


def items(data: bytes, start=0, stop=None):
    return list(concat_json.frame(io.BytesIO(data[start:]), start, stop))


def test_framing_resumes_after_errors_with_byte_offsets():
    data = '{"a": "å"} \n{"b": tru {"c": 1}[1] 7 {"d": {"e": 2}}{"f": "cut'.encode()
    found = items(data)
    assert [(k, n) for k, _, n, _ in found] == [
        ("object", 1), ("parse", 1), ("object", 2), ("other", 2), ("other", 2), ("object", 3), ("parse", 3), ("end", 3)]
    error = found[1]
    assert data[error[1] :].startswith(b"tru {")
    for kind, offset, _, text in found:
        if kind == "object":
            assert data[offset:].startswith(text.encode())
    assert data[found[-2][1] :].startswith(b'{"f"')


def test_framing_does_not_depend_on_the_chunk_size(monkeypatch):
    data = ("".join(record(i, PatientID=f"å{{}}{i}") for i in range(30)) + " [1] {bad {" + record(99)).encode()
    whole = items(data)
    for size in (7, 64, 1000):
        monkeypatch.setattr(concat_json, "CHUNK", size)
        assert items(data) == whole


EDGE = [
    record(1, RegistrationID="12"), record(2, RegistrationID=7.0), record(3, RegistrationID="x"), record(4, RegistrationID=1.5),
    record(5, PatientID=5), record(6, Timestamp="2021-07-24 13:00:00"), record(7, Hr1=None, Toco=None), record(8, Hr1={}),
    record(9, Hr1={"Values": None}), record(10, Hr1={"Values": [1, "2", 3, 4, 5]}), record(11, Hr1={"Values": [1.5]}),
    record(12, Hr1={"Values": [40000]}), record(13, Hr1={"Values": [1, 2, 3, 4, 40000]}), record(14, Toco={}),
    record(15, Toco={"Values": 5}), record(16, Hr1Mode=3), record(17, Hr1=[1]), '{"Timestamp": "7/24/2021 1:16:02 PM", "RegistrationID": 1}',
]
VALID = {1, 2, 7, 8, 10, 13}


def test_validation_rules(spark, tmp_path):
    (tmp_path / "e.json").write_text("\n".join(EDGE), encoding="utf-8")
    done = conversion.convert(spark, [str(tmp_path / "e.json")], str(tmp_path / "out"), str(tmp_path / "rej"))
    assert done == {"inputs": 1, "rows": len(VALID), "rejects": len(EDGE) - len(VALID)}
    rows = {int(r["PatientID"][-4:]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(rows) == VALID
    assert rows[1]["RegistrationID"] == 12 and rows[2]["RegistrationID"] == 7
    assert [rows[10][f"Hr1_{i}"] for i in range(4)] == [1, 2, 3, 4] and rows[8]["Hr1_0"] is None
    rejected = {r["location"] for r in spark.read.parquet(str(tmp_path / "rej")).collect()}
    assert rejected == {f"record index {i + 1}" for i in range(len(EDGE)) if i + 1 not in VALID}
    layout = spark.read.parquet(str(tmp_path / "out")).drop("source").schema
    assert {(f.name, f.dataType) for f in layout.fields} == {(f.name, f.dataType) for f in schema.RAW_FLAT.fields}


@pytest.mark.parametrize("width", [97, 211, 1009])
def test_byte_ranges_give_the_same_items_as_one_stream(spark, tmp_path, width):
    tricky = [record(i, PatientID="x} {y}{" * 9 + str(i)) if i % 3 == 0 else record(i) for i in range(40)]
    text = "".join(tricky[:20]) + '{"broken": tru {"x": 1} 7 ' + "\n".join(tricky[20:]) + '{"PatientID": "cut'
    path = tmp_path / "r.json"
    path.write_text(text, encoding="utf-8")
    frames = conversion.materialise_frames(spark, [str(path)], str(tmp_path / "work"), range_bytes=width)
    found = {(r["kind"], r["byte_offset"], r["text"]) for r in frames.where("kind not in ('start', 'end')").collect()}
    assert found == {(k, o, t) for k, o, _, t in items(text.encode()) if k != "end"}
    numbers = sorted(r["record_index"] for r in conversion.numbered_objects(frames).collect())
    assert numbers == list(range(1, len(numbers) + 1))


def test_zip_member_choice_skip_and_empty_inputs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("small.json", record(1))
        z.writestr("big.json", "".join(record(i) for i in range(5)))
        z.writestr("notes.txt", "x" * 9999)
    (tmp_path / "notes.txt").write_text("ignored")
    out, rej = str(tmp_path / "out"), str(tmp_path / "rej")
    assert conversion.convert(spark, [str(tmp_path / "*")], out, rej) == {"inputs": 1, "rows": 5, "rejects": 0}
    assert conversion.convert(spark, [str(tmp_path / "*")], out, rej, skip_existing=True)["inputs"] == 0
    assert conversion.convert(spark, [str(tmp_path / "*")], out, rej, member="small.json")["rows"] == 1
    (tmp_path / "b2.json").write_text('{"PatientID": 1}')
    done = conversion.convert(spark, [str(tmp_path / "b2.json")], out, rej)
    assert done["rows"] == 0 and done["rejects"] == 1
    assert conversion.preview(spark, [str(tmp_path / "b.zip")], 2).count() == 2
    with pytest.raises(FileNotFoundError):
        with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
            concat_json.pick_member(z)


@pytest.mark.parametrize("width", [97, 211, 900, 1009])
def test_inputs_of_one_name_in_two_folders_stay_apart(spark, tmp_path, width):
    for folder, n, text in (("a", 40, "x} {y"), ("b", 100, "plain")):
        (tmp_path / folder).mkdir()
        body = "".join(record(i, Hr1Mode=text) for i in range(n))
        (tmp_path / folder / "export.json").write_text(body + '{"PatientID": 1}')
    out, rej = str(tmp_path / "out"), str(tmp_path / "rej")
    done = conversion.convert(spark, [str(tmp_path / "*" / "export.json")], out, rej, range_bytes=width)
    assert done == {"inputs": 2, "rows": 140, "rejects": 2}
    counts = sorted(r["count"] for r in spark.read.parquet(out).groupBy("source").count().collect())
    assert counts == [40, 100]
    assert {r["location"] for r in spark.read.parquet(rej).collect()} == {"record index 41", "record index 101"}


def test_rejects_of_earlier_runs_stay_until_their_input_is_clean(spark, tmp_path):
    out, rej = str(tmp_path / "out"), str(tmp_path / "rej")
    first, second = tmp_path / "one.json", tmp_path / "two.json"
    first.write_text(record(1) + '{"PatientID": 1}')
    assert conversion.convert(spark, [str(first)], out, rej) == {"inputs": 1, "rows": 1, "rejects": 1}
    second.write_text(record(2) + "[1, 2]")
    done = conversion.convert(spark, [str(first), str(second), str(tmp_path / "*.json")], out, rej, skip_existing=True)
    assert done == {"inputs": 1, "rows": 1, "rejects": 0}
    assert spark.read.parquet(rej).count() == 1 and spark.read.parquet(out).count() == 2
    first.write_text(record(1))
    assert conversion.convert(spark, [str(first)], out, rej) == {"inputs": 1, "rows": 1, "rejects": 0}
    assert not [p for p in (tmp_path / "rej").iterdir() if p.name.startswith("input=")]


def test_each_text_is_parsed_once(spark):
    """A filter on the problems must not carry the parse below the projections, once per mention."""
    texts = ['{"PatientID":"p","RegistrationID":1,"Timestamp":"1/2/2024 1:16:05 PM","Hr1":{"Values":[1,2]}}', "{}", "[", None]
    objects = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "source string, record_index long, text string")
    parsed = conversion.parsed_records(objects.repartition(2))
    layout = conversion.flat_layout(parsed)
    for found in (conversion.flat_rows(layout), layout.where(F.size("problems") > 0)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert [r["PatientID"] for r in conversion.flat_rows(layout).collect()] == ["p"]
    bad = {r["record_index"]: r["problems"] for r in layout.where(F.size("problems") > 0).collect()}
    assert sorted(bad) == [1, 2, 3] and bad[1][:3] == ["PatientID", "RegistrationID", "Timestamp"]
