from __future__ import annotations

import base64
from datetime import date

import pytest
from pyspark.sql import functions as F

from vitalspan.functions import dates, signal, text


def values(spark, cells, expr, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r["v"] for r in rows.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_mean_of_positive_samples_truncates(spark):
    rows = spark.createDataFrame(
        [(140, 141, 0, None), (-3, 0, 0, 0), (None, None, None, None), (1, 0, 0, 0)], "a short, b short, c short, d short"
    )
    samples = [F.col(c) for c in "abcd"]
    assert [r[0] for r in rows.select(signal.mean_positive(samples)).collect()] == [140.0, 0.0, 0.0, 1.0]
    doubles = rows.select(*[F.col(c).cast("double") for c in "abcd"])
    assert doubles.select(signal.mean_positive(samples, integral=False)).first()[0] == pytest.approx(140.5)


@pytest.mark.parametrize(
    "payload, expected",
    [([0, 1, 99, 100], 50.0), ([0, 100, 200, 255], 138.75), ([5], 5.0), ([], 0.0), ([10, 20, 0, 0, 30], 20.0), ([1, 2, 3], 2.0)],
)
def test_toco_level(spark, payload, expected):
    rows = spark.createDataFrame([(base64.b64encode(bytes(payload)).decode(),)], "c string")
    assert signal.with_toco_level(rows, "c", "t").first()["t"] == pytest.approx(expected)


def test_toco_level_of_bad_text(spark):
    cells = [None, "abc", "****", "A*AECAw=="]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    found = [r["t"] for r in signal.with_toco_level(rows, "c", "t").orderBy("i").collect()]
    assert found == [0.0, 0.0, 0.0, 2.0]
    four = [base64.b64encode(bytes([0, 7, 99, 255])).decode(), "AAE=", None]
    assert values(spark, four, signal.toco_samples) == [[0.0, 7.0, 99.0, 255.0], [None] * 4, [None] * 4]


def test_numbers(spark):
    cells = ["7,12", "7.6", "6.5", "-7.6", "1e2", " ", "x", None, "5d", "nan", "99999999999"]
    assert values(spark, cells, text.comma_int) == [7, 8, 7, -8, 100, None, None, None, None, None, None]
    assert values(spark, cells, text.comma_double)[:5] == [7.12, 7.6, 6.5, -7.6, 100.0]
    assert values(spark, cells, text.comma_int_truncated)[:5] == [7, 7, 6, -7, 100]


def test_codes(spark):
    cells = ["O13", "XO13", "O130", "o 13,A1", "O13-1", None, "A1,O16X"]
    prefix = lambda c: text.has_code_prefix(text.code_list(c), ["O13", "O16"])
    exact = lambda c: text.has_code(text.code_list(c), ["O13"])
    assert values(spark, cells, prefix) == [True, False, True, True, False, False, True]
    assert values(spark, cells, exact) == [True, False, False, True, False, False, False]


def test_words_and_keys(spark):
    assert values(spark, ["Ja", " nej", "1", None], text.yes_no) == [True, False, None, None]
    assert values(spark, ["1.0", "1", "TRUE", "nej", "x"], text.tidy_boolean) == [None, True, True, False, None]
    assert values(spark, ["123.0", " 1 2 ", "", "5.00"], text.join_key) == ["123", "12", None, "5"]
    assert values(spark, ["198001011234", "19800101-1234", "123", " 123456789 "], text.dashed_person_id) == [
        "19800101-1234", "19800101-1234", "123", "12345678-9"]
    assert values(spark, ["19800101-1234", "19800101-12x4", None], lambda c: text.suffix_bucket(c, 256)) == [1234 % 256, -1, -1]
    assert values(spark, ["1–9 Cigg/dag", None, "snus"], lambda c: text.mentions(c, "cigg")) == [True, False, False]


def test_dates(spark):
    assert values(spark, ["2020-02-29", "2021-02-30", "2020", ""], text.text_date) == [date(2020, 2, 29), None, None, None]
    assert values(spark, ["19800229", "19810229", "1980"], dates.date_from_digits) == [date(1980, 2, 29), None, None]
    rows = spark.createDataFrame([(date(2000, 3, 2), date(2020, 3, d)) for d in (1, 2, 3)], "a date, b date")
    years = rows.select(dates.completed_years(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in years] == [19, 20, 20]
    born = spark.createDataFrame([(date(2020, 1, 1), date(2020, 1, 29)), (date(2020, 1, 1), date(2020, 1, 30)), (date(2020, 1, 2), date(2020, 1, 1))], "a date, b date")
    assert [r[0] for r in born.select(dates.days_if_within(F.col("a"), F.col("b"), 0, 28)).collect()] == [28, None, None]


def test_clock_text(spark):
    found = values(spark, ["7/24/2021 1:16:02 PM", "12/1/2020 12:00:00 AM", "2021-07-24", None], dates.clock_text_to_timestamp)
    assert [str(v) if v else None for v in found] == ["2021-07-24 13:16:02", "2020-12-01 00:00:00", None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Stockholm"])
def test_epoch_micros_ignores_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.sql("SELECT timestamp_ntz'2021-03-28 02:30:00.123456' AS t UNION ALL SELECT timestamp_ntz'1969-12-31 23:59:59.5'")
        found = [r[0] for r in rows.select(dates.epoch_micros(F.col("t"))).collect()]
        assert found == [1616898600123456, -500000]
        assert [r[0] for r in rows.select(dates.time_cell(F.col("t"), 3600)).collect()] == [449138, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
