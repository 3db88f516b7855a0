"""Queries on whole stages: records, reduction, birth windows, modelling joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import DAY, as_double, as_text, query, six, table
from vitalspan.catalog.modelling import SPLIT_SQL, STEPS, quality_labels
from vitalspan.catalog.parsing import RAW_REGISTRY
from vitalspan.catalog.series import SESSIONED_SQL
from vitalspan.config import ReductionSettings, SplitSettings
from vitalspan.functions.keys import stable_order
from vitalspan.functions.text import suffix_bucket
from vitalspan.operators import quality, reports, sequences, splits, tabular
from vitalspan.plans import conversion, modelling, patients, reduction
from vitalspan.sources.tables import with_columns_or_null

# Events as JSON objects, with a broken field for some keys; both engines build the same text.
RECORD_FIELDS = [
    ("PatientID", "CASE WHEN event_id % 17 = 0 THEN '5' ELSE '\"p' || CAST(user_id AS STRING) || '\"' END"),
    ("RegistrationID", "CASE event_id % 13 WHEN 0 THEN '1.5' WHEN 1 THEN '\"' || CAST(event_id AS STRING) || '\"' ELSE CAST(event_id AS STRING) END"),
    ("Timestamp", "CASE WHEN event_id % 19 = 0 THEN '\"2024-01-01\"' ELSE '\"1/' || CAST(1 + user_id % 28 AS STRING) || '/2024 1:16:0' || CAST(event_id % 10 AS STRING) || ' PM\"' END"),
    ("Hr1", "CASE event_id % 11 WHEN 0 THEN 'null' WHEN 1 THEN '{\"Values\":[1,40000]}' WHEN 2 THEN '{\"Values\":[1,\"2\"]}' "
            "ELSE '{\"Values\":[' || CAST(user_id % 200 AS STRING) || ',0,3,4,5],\"SignalQuality\":\"G\"}' END"),
    ("Toco", "CASE WHEN event_id % 23 = 0 THEN '{}' ELSE '{\"Values\":\"AAECAw==\"}' END"),
]
RECORD_TEXT = "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {e}" for n, e in RECORD_FIELDS) + " || '}'"

RECORD_SQL = """
good AS (SELECT *, event_id % 17 <> 0 AS ok_person, event_id % 13 <> 0 AS ok_registration, event_id % 19 <> 0 AS ok_time,
                event_id % 11 <> 1 AS ok_range, event_id % 23 <> 0 AS ok_toco FROM events)"""


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed records, one per event."""
    texts = table(spark, sf_dir, "events").selectExpr(
        "'events' AS source", "event_id AS record_index", f"{RECORD_TEXT} AS text"
    )
    return conversion.parsed_records(texts)


@query(
    "json_flatten",
    f"""WITH {RECORD_SQL} SELECT 'p' || CAST(user_id AS VARCHAR) AS patient, event_id AS registration,
        make_timestamp(2024, 1, 1 + user_id % 28, 13, 16, CAST(event_id % 10 AS DOUBLE)) AS moment,
        CAST(CASE event_id % 11 WHEN 0 THEN NULL WHEN 2 THEN 1 ELSE user_id % 200 END AS DOUBLE) AS first_sample,
        CAST(CASE event_id % 11 WHEN 0 THEN NULL WHEN 2 THEN 2 ELSE 0 END AS DOUBLE) AS second_sample,
        CAST(CASE WHEN event_id % 11 IN (0, 2) THEN NULL ELSE 4 END AS DOUBLE) AS fourth_sample,
        CASE WHEN event_id % 11 IN (0, 2) THEN NULL ELSE 'G' END AS quality, 'AAECAw==' AS toco_text
    FROM good WHERE ok_person AND ok_registration AND ok_time AND ok_range AND ok_toco""",
)
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversion.flat_rows(conversion.flat_layout(event_records(spark, sf_dir)))
    return rows.select(
        F.col("PatientID").alias("patient"),
        F.col("RegistrationID").alias("registration"),
        F.col("Timestamp").alias("moment"),
        F.col("Hr1_0").cast("double").alias("first_sample"),
        F.col("Hr1_1").cast("double").alias("second_sample"),
        F.col("Hr1_3").cast("double").alias("fourth_sample"),
        F.col("Hr1_SignalQuality").alias("quality"),
        F.col("Toco_Values").alias("toco_text"),
    )


@query(
    "json_rejects",
    f"""WITH {RECORD_SQL} SELECT 'record index ' || CAST(event_id AS VARCHAR) AS location, 'invalid ' || concat_ws(', ',
        CASE WHEN NOT ok_person THEN 'PatientID' END, CASE WHEN NOT ok_registration THEN 'RegistrationID' END,
        CASE WHEN NOT ok_time THEN 'Timestamp' END, CASE WHEN NOT ok_range THEN 'Hr1.Values range' END,
        CASE WHEN NOT ok_toco THEN 'Toco.Values' END) AS message
    FROM good WHERE NOT (ok_person AND ok_registration AND ok_time AND ok_range AND ok_toco)""",
)
def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = event_records(spark, sf_dir)
    no_frames = parsed.select(
        "source", F.lit("object").alias("kind"), F.lit(0).cast("bigint").alias("byte_offset"), F.lit("").alias("text")
    )
    return conversion.rejects(no_frames, parsed).select("location", "message")


@query(
    "optional_columns",
    "SELECT event_id, value, CAST(NULL AS VARCHAR) AS quality, event_type FROM events",
)
def optional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_columns_or_null(table(spark, sf_dir, "events"), ["event_id", "value", "quality", "event_type"])


@query(
    "bucket_filter",
    "SELECT c_custkey, c_name FROM customer WHERE CAST(right(c_name, 4) AS INTEGER) % 16 = 3",
)
def bucket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return rows.where(suffix_bucket(F.col("c_name"), 16) == 3)


REDUCE_SQL = f"""WITH {SESSIONED_SQL},
windowed AS (
    SELECT sha256(concat('salt', '|', 'p' || CAST(s.user_id AS VARCHAR), '|', CAST(f.session_end AS VARCHAR))) AS subject,
           s.user_id, date_trunc('hour', s.ts) AS h, CAST(s.value AS FLOAT) AS value,
           CAST(json_extract_string(s.props, '$.k') AS FLOAT) AS toco, s.event_type
    FROM sessioned s JOIN finals f ON s.user_id = f.user_id AND s.session_id = f.session_id
    WHERE s.ts BETWEEN f.last_positive_ts - INTERVAL 12 HOURS AND f.last_positive_ts),
levels AS (SELECT subject, h, event_type, row_number() OVER (PARTITION BY subject, h ORDER BY count(*) DESC, event_type) AS place
           FROM windowed GROUP BY subject, h, event_type),
voted AS (
    SELECT subject, min(user_id) AS user_id, h, count(*) AS copies, CAST(median(value) FILTER (WHERE value > 0) AS FLOAT) AS rate,
           CAST(coalesce(median(toco) FILTER (WHERE toco BETWEEN 1 AND 99), median(toco)) AS FLOAT) AS toco
    FROM windowed GROUP BY subject, h),
kept AS (SELECT subject, max(h) AS last_h FROM voted GROUP BY 1
         HAVING avg(CASE WHEN copies > 1 THEN 1.0 ELSE 0.0 END) <= 0.3 AND count(*) FILTER (WHERE rate > 0) >= 2)
SELECT v.subject, 'p' || CAST(v.user_id AS VARCHAR) AS patient, v.h, round(CAST(v.rate AS DOUBLE), 3) AS rate,
       round(CAST(v.toco AS DOUBLE), 3) AS toco, l.event_type, CAST(CAST(k.last_h AS DATE) AS VARCHAR) AS anchor_date
FROM voted v JOIN kept k USING (subject) JOIN levels l ON l.subject = v.subject AND l.h = v.h AND l.place = 1"""


@query("cohort_reduction", REDUCE_SQL)
def cohort_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing windows of the event series, voted per hour, filtered and dated."""
    settings = ReductionSettings(
        salt="salt", gap_minutes=360, episode_gap_days=2, window_minutes=720, min_positive_seconds=2
    )
    rows = table(spark, sf_dir, "events")
    series = rows.select(
        F.col("ts").alias("Timestamp"),
        F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("PatientID"),
        F.col("event_id").alias("RegistrationID"),
        F.col("value").cast("float").alias("FHR"),
        F.get_json_object("props", "$.k").cast("float").alias("toco"),
        F.col("event_type").alias("Hr1_SignalQuality"),
        F.lit(None).cast("string").alias("Hr1Mode"),
        F.lit(None).cast("string").alias("TocoMode"),
    )
    windows = reduction.closing_session_rows(series, settings)
    hourly = windows.withColumn("Timestamp", F.date_trunc("HOUR", "Timestamp").cast("timestamp_ntz"))
    found = reduction.reduce_windows(hourly, settings)
    return found.select(
        F.col("BabyID").alias("subject"),
        F.col("PatientID").alias("patient"),
        F.col("Timestamp").alias("h"),
        F.round(F.col("FHR").cast("double"), 3).alias("rate"),
        F.round(F.col("toco").cast("double"), 3).alias("toco"),
        F.col("Hr1_SignalQuality").alias("event_type"),
        F.col("ctg_date").cast("string").alias("anchor_date"),
    )


@query(
    "birth_day_window",
    """WITH people AS (SELECT o_custkey, CASE WHEN o_custkey % 40 > 0 THEN CAST(max(o_orderdate) AS DATE) END AS day FROM orders GROUP BY 1),
    shipped AS (SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)
    SELECT s.l_orderkey, s.l_linenumber, s.l_shipdate, s.o_custkey FROM shipped s JOIN people p ON s.o_custkey = p.o_custkey
    WHERE p.day IS NULL OR (s.l_shipdate >= p.day - INTERVAL 1 DAY AND s.l_shipdate < p.day + INTERVAL 1 DAY)""",
)
def birth_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order date of a customer as birth day, unknown for some."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "PatientID")
    people = orders.groupBy("PatientID").agg(F.max("o_orderdate").cast("date").alias("_last"))
    known = F.when(F.col("PatientID") % 40 > 0, F.col("_last"))
    owners = orders.select(F.col("o_orderkey").alias("l_orderkey"), "PatientID")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("Timestamp"))
    found = patients.birth_window(lines.join(owners, "l_orderkey"), people.select("PatientID", known.alias("birth_day")))
    return found.select(
        "l_orderkey", "l_linenumber", F.col("Timestamp").alias("l_shipdate"), F.col("PatientID").alias("o_custkey")
    )


@query(
    "labelled_pick",
    """SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IN (SELECT doc_id FROM documents)
    ORDER BY md5('3|' || CAST(doc_id AS VARCHAR)) LIMIT 1""",
)
def labelled_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where(F.col("quality") == 0).select("doc_id")
    known = table(spark, sf_dir, "documents").select("doc_id")
    return chosen.join(known, "doc_id", "left_semi").orderBy(stable_order(F.col("doc_id"), 3)).limit(1)


@query(
    "distinct_values",
    "SELECT count(DISTINCT user_id) AS n_distinct FROM events",
)
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.distinct_values(table(spark, sf_dir, "events"), "user_id")


@query(
    "merge_splits",
    f"""WITH {SPLIT_SQL} SELECT s.doc_id, s.split, CAST(d.n_chars AS DOUBLE) AS n_chars
    FROM splits s LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON s.doc_id = d.doc_id""",
)
def merge_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = splits.stratified_split(quality_labels(spark, sf_dir), SplitSettings(), "doc_id").drop("target")
    english = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id", "n_chars")
    return as_double(tabular.merge_splits(made, english, "doc_id"), "n_chars")


@query(
    "signal_moments",
    f"""WITH ranked AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
    SELECT round(avg(v), 4) AS value_mean, round(stddev_pop(v), 4) AS value_std
    FROM (SELECT CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM ranked WHERE place <= {STEPS})""",
)
def signal_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = sequences.padded_sequences(
        table(spark, sf_dir, "events"), "user_id", "ts", STEPS, {"value": F.col("value")}, {"value": float("nan")},
        cell_seconds=7 * DAY, tie=["event_id"],
    )
    found = sequences.signal_moments(built, ["value"])
    return found.select(*[F.round(c, 4).alias(c) for c in ("value_mean", "value_std")])


@query(
    "keys_with_enough",
    "SELECT user_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_hits FROM events GROUP BY 1 HAVING sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) >= 24",
)
def keys_with_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.keys_with_enough(table(spark, sf_dir, "events"), "user_id", F.col("value") > 50, 24)


@query(
    "patient_list",
    f"""WITH raw AS (SELECT {RAW_REGISTRY["personnummer_mor"]} AS person, {RAW_REGISTRY["forlossningsdatum_fv1"]} AS day,
        {RAW_REGISTRY["apgar_5_min"]} AS score FROM orders)
    SELECT person, CAST(TRY_CAST(day AS DATE) AS VARCHAR) AS birth_day, CAST(CAST(TRY_CAST(replace(score, ',', '.') AS DOUBLE) AS INTEGER) AS VARCHAR) AS apgar5, count(*) AS n_rows
    FROM raw GROUP BY 1, 2, 3""",
)
def patient_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = table(spark, sf_dir, "orders").selectExpr(
        *[f"{RAW_REGISTRY[c]} AS {c}" for c in ("personnummer_mor", "forlossningsdatum_fv1", "apgar_5_min")]
    )
    listed = patients.patient_list(registry)
    counted = listed.groupBy(F.col("PatientID").alias("person"), "birth_day", "apgar5").agg(F.count(F.lit(1)).alias("n_rows"))
    return as_text(counted, "birth_day", "apgar5")


NEWTON_STEPS = 12


def _newton_sql() -> str:
    """Two weights and an intercept by unrolled Newton steps; each solves three equations by determinants."""
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v)"]
    for k in range(NEWTON_STEPS):
        steps.append(f"""s{k} AS (SELECT sum(r) AS g, sum(r * z1) + any_value(u) AS g1, sum(r * z2) + any_value(v) AS g2,
            sum(h) AS h00, sum(h * z1) AS h01, sum(h * z2) AS h02,
            sum(h * z1 * z1) + 1 AS h11, sum(h * z1 * z2) AS h12, sum(h * z2 * z2) + 1 AS h22
          FROM (SELECT z1, z2, u, v, w * (1 / (1 + exp(-(b + u * z1 + v * z2))) - target) AS r,
                  w / (1 + exp(-(b + u * z1 + v * z2))) * (1 - 1 / (1 + exp(-(b + u * z1 + v * z2)))) AS h FROM train, b{k}))""")
        steps.append(f"""d{k} AS (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{k})""")
        steps.append(f"""b{k + 1} AS (SELECT
            b - (g * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b,
            u - (h00 * (g1 * h22 - h12 * g2) - g * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS u,
            v - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g * (h01 * h12 - h11 * h02)) / det AS v
          FROM b{k}, d{k})""")
    return ",\n".join(steps)


_BASELINE_SQL = f"""WITH {SPLIT_SQL},
raw AS (SELECT s.doc_id, s.split, s.target, ln(1 + n_chars) AS x1,
    length(regexp_replace(text, '\\S', '', 'g')) / greatest(n_chars, 1) AS x2
  FROM splits s JOIN documents USING (doc_id)),
moments AS (SELECT avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2 FROM raw WHERE split = 'train'),
scaled AS (SELECT doc_id, split, target, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2 FROM raw, moments),
sizes AS (SELECT count(*) AS n, sum(target) AS n1 FROM scaled WHERE split = 'train'),
train AS (SELECT *, CASE WHEN target = 1 THEN n / (2 * n1) ELSE n / (2 * (n - n1)) END AS w
  FROM scaled, sizes WHERE split = 'train'),
{_newton_sql()}
SELECT doc_id, split, target, round(1 / (1 + exp(-(b + u * z1 + v * z2))), 4) AS score FROM scaled, b{NEWTON_STEPS}"""


@query("baseline_classifier", _BASELINE_SQL)
def baseline_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-balanced logistic regression on text lengths."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.log1p(F.col("n_chars").cast("double")).alias("size"),
        (F.length(F.regexp_replace("text", r"\S", "")) / F.greatest(F.col("n_chars"), F.lit(1))).alias("blank_share"),
    )
    made = splits.stratified_split(quality_labels(spark, sf_dir), SplitSettings(), "doc_id").join(docs, "doc_id")
    model = modelling.fit_baseline(made.where(F.col("split") == "train"), ["size", "blank_share"])
    scored = model.score(made, ["doc_id", "split", "target"])
    return scored.select("doc_id", "split", "target", F.round("score", 4).alias("score"))
