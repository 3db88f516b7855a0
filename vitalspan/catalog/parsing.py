"""Queries on text parsing and the registry, over text cells derived from the given tables.

The raw text cells are written once in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog.base import as_text, query, six, table
from vitalspan.functions import dates, text
from vitalspan.operators import matching, registry, reports
from vitalspan.operators.skew import dealt
from vitalspan.plans.matching import enriched_registry
from vitalspan.sources.tables import spread_scan

# Text cells per order: edge values picked by the order key.
CELLS = {
    "number_text": """CASE o_orderkey % 11 WHEN 0 THEN '7,12' WHEN 1 THEN ' 7.6' WHEN 2 THEN '' WHEN 3 THEN '  '
        WHEN 4 THEN 'okänt' WHEN 5 THEN '-7,6' WHEN 6 THEN '6.5' WHEN 7 THEN '1e2' WHEN 8 THEN NULL
        WHEN 9 THEN CAST(o_totalprice AS STRING) ELSE CAST(o_custkey AS STRING) END""",
    "word_text": """CASE o_orderkey % 9 WHEN 0 THEN 'Ja' WHEN 1 THEN ' nej ' WHEN 2 THEN 'JA' WHEN 3 THEN 'Vet ej'
        WHEN 4 THEN '1' WHEN 5 THEN 'true' WHEN 6 THEN ' False' WHEN 7 THEN '1.0' ELSE NULL END""",
    "habit_text": """CASE o_orderkey % 5 WHEN 0 THEN '1–9 Cigg/dag' WHEN 1 THEN 'Röker inte' WHEN 2 THEN '>10 CIGG'
        WHEN 3 THEN NULL ELSE ' ' END""",
    "code_text": """CASE o_orderkey % 8 WHEN 0 THEN 'o13, O24.4' WHEN 1 THEN ' O130 ,O711' WHEN 2 THEN 'XO13,P90'
        WHEN 3 THEN 'O14,O13-9' WHEN 4 THEN NULL WHEN 5 THEN 'O16A' WHEN 6 THEN 'o710 , O62 0' ELSE 'O711X,O13' END""",
    "key_text": """CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS STRING) || '.0' WHEN 1 THEN ' 12 3' || CAST(o_custkey AS STRING)
        WHEN 2 THEN '' ELSE CAST(o_custkey AS STRING) || '.00 ' END""",
    "date_text": """CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN '2021-02-30'
        WHEN 2 THEN ' 2020-02-29 ' WHEN 3 THEN '' WHEN 4 THEN 'igår' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END""",
}
CELLS_SQL = "cells AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in CELLS.items()) + " FROM orders)"


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in CELLS.items()])


@query(
    "clean_text",
    f"WITH {CELLS_SQL} SELECT o_orderkey, nullif(trim(number_text), '') AS number_text, nullif(trim(word_text), '') AS word_text FROM cells",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_cells(spark, sf_dir)
    return rows.select("o_orderkey", *[text.clean_text(F.col(c)).alias(c) for c in ("number_text", "word_text")])


@query(
    "try_int_comma",
    f"""WITH {CELLS_SQL} SELECT o_orderkey, CAST(TRY_CAST(replace(trim(number_text), ',', '.') AS INTEGER) AS VARCHAR) AS whole,
        CAST(CAST(trunc(TRY_CAST(replace(trim(number_text), ',', '.') AS DOUBLE)) AS INTEGER) AS VARCHAR) AS truncated FROM cells""",
)
def try_int_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("number_text")
    rows = order_cells(spark, sf_dir).select(
        "o_orderkey", text.comma_int(cell).alias("whole"), text.comma_int_truncated(cell).alias("truncated")
    )
    return as_text(rows, "whole", "truncated")


@query(
    "try_double_comma",
    f"WITH {CELLS_SQL} SELECT o_orderkey, TRY_CAST(replace(trim(number_text), ',', '.') AS DOUBLE) AS number FROM cells",
)
def try_double_comma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir).select("o_orderkey", text.comma_double(F.col("number_text")).alias("number"))


@query(
    "bool_words",
    f"""WITH {CELLS_SQL} SELECT o_orderkey,
        CASE lower(trim(word_text)) WHEN 'ja' THEN 'true' WHEN 'nej' THEN 'false' END AS yes_no,
        CASE WHEN lower(trim(word_text)) IN ('ja', '1', 'true') THEN 'true'
             WHEN lower(trim(word_text)) IN ('nej', '0', 'false') THEN 'false' END AS tidy FROM cells""",
)
def bool_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("word_text")
    rows = order_cells(spark, sf_dir).select(
        "o_orderkey", text.yes_no(cell).alias("yes_no"), text.tidy_boolean(cell).alias("tidy")
    )
    return as_text(rows, "yes_no", "tidy")


@query(
    "substring_flag",
    f"WITH {CELLS_SQL} SELECT o_orderkey, coalesce(lower(habit_text), '') LIKE '%cigg%' AS smokes FROM cells",
)
def substring_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir).select("o_orderkey", text.mentions(F.col("habit_text"), "cigg").alias("smokes"))


SPLIT_SQL = "string_split(regexp_replace(upper(coalesce(code_text, '')), '\\s+', '', 'g'), ',')"


@query(
    "code_prefix_match",
    f"""WITH {CELLS_SQL} SELECT o_orderkey,
        len([x FOR x IN {SPLIT_SQL} IF regexp_full_match(x, '(O13|O16)[A-Z0-9]*')]) > 0 AS has_prefix FROM cells""",
)
def code_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = text.code_list(F.col("code_text"))
    return order_cells(spark, sf_dir).select(
        "o_orderkey", text.has_code_prefix(codes, ["O13", "O16"]).alias("has_prefix")
    )


@query(
    "code_exact_match",
    f"""WITH {CELLS_SQL} SELECT o_orderkey, list_has_any({SPLIT_SQL}, ['O710', 'O711', 'O620']) AS has_code FROM cells""",
)
def code_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = text.code_list(F.col("code_text"))
    return order_cells(spark, sf_dir).select(
        "o_orderkey", text.has_code(codes, ["O710", "O711", "O620"]).alias("has_code")
    )


@query(
    "part_code_lists",
    """WITH lists AS (
        SELECT l_orderkey, string_agg(DISTINCT upper(p.p_type), ',') AS codes
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY 1)
    SELECT l_orderkey, list_has_any(string_split(codes, ','), ['ECONOMY', 'LARGE']) AS has_exact,
           len([x FOR x IN string_split(codes, ',') IF starts_with(x, 'MED')]) > 0 AS has_prefix FROM lists""",
)
def part_code_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    kinds = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey")
    lists = kinds.groupBy("l_orderkey").agg(F.array_join(F.collect_set("p_type"), ",").alias("codes"))
    codes = text.code_list(F.col("codes"))
    return lists.select(
        "l_orderkey",
        text.has_code(codes, ["ECONOMY", "LARGE"]).alias("has_exact"),
        text.has_code_prefix(codes, ["MED"]).alias("has_prefix"),
    )


@query(
    "join_key_clean",
    f"""WITH {CELLS_SQL} SELECT o_orderkey,
        nullif(replace(regexp_replace(trim(key_text), '\\.0+$', ''), ' ', ''), '') AS join_key FROM cells""",
)
def join_key_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cells(spark, sf_dir).select("o_orderkey", text.join_key(F.col("key_text")).alias("join_key"))


@query(
    "person_key",
    """SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits,
        substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 8) || '-' || substr(regexp_replace(c_name, '[^0-9]', '', 'g'), 9, 4) AS person,
        left(c_name, 8) || '-' || substr(c_name, 9) AS dashed FROM customer""",
)
def person_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = text.digits_only(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        digits.alias("digits"),
        text.person_key(digits).alias("person"),
        text.dashed_person_id(F.col("c_name")).alias("dashed"),
    )


@query(
    "try_date",
    f"WITH {CELLS_SQL} SELECT o_orderkey, CAST(TRY_CAST(trim(date_text) AS DATE) AS VARCHAR) AS day FROM cells",
)
def try_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(order_cells(spark, sf_dir).select("o_orderkey", text.text_date(F.col("date_text")).alias("day")), "day")


LINE_DATES_SQL = """FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""


def line_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").cast("date").alias("shipped")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("ordered"))
    return lines.join(orders, "o_orderkey")


@query(
    "age_years",
    f"""SELECT o_orderkey, l_linenumber, CAST(date_diff('year', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))
        - CASE WHEN strftime(l_shipdate, '%m-%d') < strftime(o_orderdate, '%m-%d') THEN 1 ELSE 0 END AS INTEGER) AS years
    {LINE_DATES_SQL}""",
)
def age_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = dates.completed_years(F.col("ordered"), F.col("shipped")).alias("years")
    return line_dates(spark, sf_dir).select("o_orderkey", "l_linenumber", years)


@query(
    "date_diff_units",
    f"""SELECT o_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS n_days,
        date_diff('second', o_orderdate, l_shipdate + INTERVAL 1 MINUTE) AS n_seconds,
        CAST(year(l_shipdate) - year(o_orderdate) AS BIGINT) AS n_year_steps {LINE_DATES_SQL}""",
)
def date_diff_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered, shipped = F.col("ordered"), F.col("shipped")
    later = dates.plus_seconds(dates.to_zoneless(shipped), 60)
    return line_dates(spark, sf_dir).select(
        "o_orderkey",
        "l_linenumber",
        F.datediff(shipped, ordered).cast("bigint").alias("n_days"),
        dates.seconds_between(dates.to_zoneless(ordered), later).alias("n_seconds"),
        (F.year(shipped) - F.year(ordered)).cast("bigint").alias("n_year_steps"),
    )


@query(
    "date_plus_seconds",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + to_seconds(CAST(o_custkey * 37 % 86400 AS BIGINT)) END AS moment
    FROM orders""",
)
def date_plus_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") * 37 % 86_400)
    moment = dates.date_with_seconds(F.col("o_orderdate").cast("date"), seconds)
    return table(spark, sf_dir, "orders").select("o_orderkey", moment.alias("moment"))


@query(
    "date_within_days",
    f"""SELECT o_orderkey, l_linenumber, CAST(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 28
        THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS DOUBLE) AS n_days {LINE_DATES_SQL}""",
)
def date_within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = dates.days_if_within(F.col("ordered"), F.col("shipped"), 0, 28).cast("double")
    return line_dates(spark, sf_dir).select("o_orderkey", "l_linenumber", gap.alias("n_days"))


@query(
    "ph_fallback",
    """SELECT l_orderkey, l_linenumber, CAST(coalesce(CASE WHEN l_discount > 0.02 THEN l_quantity END,
        CASE WHEN l_tax > 0.02 THEN l_extendedprice / 1000 END) < 7 AS VARCHAR) AS below_seven FROM lineitem""",
)
def ph_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    artery = F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))
    vein = F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice") / 1000)
    below = (F.coalesce(artery, vein) < registry.ACIDOSIS_LIMIT).alias("below_seven")
    return as_text(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", below), "below_seven")


def _pick(column: str, modulus: int, values: list[str | None]) -> str:
    """CASE expression that cycles through values by a key."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v + "'") for i, v in enumerate(values)
    )
    return f"CASE {column} % {modulus} {arms} END"


def _digits(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


# A registry in its raw text form, one row per order.
RAW_REGISTRY = {
    "glopnr": "CAST(o_orderkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '.0' ELSE '' END",
    "personnummer_mor": "CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 51 = 0 THEN '1980' ELSE '19' || "
    + _digits("50 + o_custkey % 50", 2) + " || " + _digits("1 + o_custkey % 12", 2) + " || "
    + _digits("1 + o_custkey % 31", 2) + " || '-' || " + _digits("o_custkey % 10000", 4) + " END",
    "forlossningsdatum_fv1": "CASE WHEN o_orderkey % 40 = 0 THEN '2021-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "forlossningstid_fv1": "CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_custkey * 31 % 86400 AS STRING) END",
    "etablerade_varkar_datum": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "etablerade_varkar_tid": "CAST(o_orderkey * 17 % 86400 AS STRING)",
    "forlossningsstart_basta_skattning": _pick("o_orderkey", 4, ["Spontan", " Induktion ", "", None]),
    "forlossningsslut_basta_skattning": _pick("o_custkey", 3, ["Vaginal", "Sectio", None]),
    "apgar_1_min": "CAST(o_orderkey % 11 AS STRING)",
    "apgar_5_min": "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(o_custkey % 11 AS STRING) || ',0' END",
    "apgar_10_min": _pick("o_orderkey", 5, ["9", "10,0", "okänt", None, "7.6"]),
    "gl_v_barn": "CAST(35 + o_custkey % 8 AS STRING)",
    "gl_d_barn": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 7 AS STRING) END",
    "fodelseland": _pick("o_custkey", 6, ["SVERIGE", "NORGE", " FINLAND", "", None, "IRAK"]),
    "utbildningsniva": _pick("o_custkey", 4, ["Grundskola", "Gymnasium", "Högskola", None]),
    "para_mhv1": _pick("o_orderkey", 5, ["0", "1", "2,0", "x", None]),
    "langd_inskrivning_cm": "CAST(150 + o_custkey % 40 AS STRING) || ',5'",
    "bmi_inskrivning": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(18 + o_custkey % 20 AS STRING) || '.25' END",
    "tidigare_sectio": _pick("o_orderkey", 3, ["Ja", "nej", None]),
    "tobak_3_manader_fore_graviditet": _pick("o_orderkey", 4, ["1–9 cigg/dag", "Röker inte", None, "Snus"]),
    "tobak_inskrivning": _pick("o_custkey", 5, ["Röker inte", "≥10 Cigg/dag", "", None, "Snus"]),
    "tobak_vecka_30_32": _pick("o_orderkey", 7, ["Röker inte", None, None, "", "1−9 CIGG", "Snus", "Uppgift saknas"]),
    "diabetes_mellitus": _pick("o_orderkey", 4, ["Ja", "Nej", "Vet ej", None]),
    "kon": _pick("o_orderkey", 4, ["Flicka", "Pojke", "Okänt", None]),
    "alkohol_audit_poang": _pick("o_orderkey", 4, ["0", "5", "6.5", None]),
    "ph_navelartar": _pick("o_orderkey", 5, ["7,12", "6,95", "", None, "7.00"]),
    "ph_navelven": _pick("o_orderkey", 3, ["7,30", "6.99", None]),
    "avled_datum": "CASE WHEN o_orderkey % 20 = 0 THEN CAST(CAST(o_orderdate + INTERVAL '3' DAY AS DATE) AS STRING) "
    "WHEN o_orderkey % 20 = 1 THEN CAST(CAST(o_orderdate + INTERVAL '29' DAY AS DATE) AS STRING) "
    "WHEN o_orderkey % 20 = 2 THEN CAST(CAST(o_orderdate + INTERVAL '28' DAY AS DATE) AS STRING) ELSE '' END",
    "moderns_diagnoser_rad": _pick("o_orderkey", 9, ["O130, o24", "XO13,O711", "O46 1", None, "O14-1,O15", "A419,O690", "O660,O16", "O620 , O67", ""]),
    "moderns_atgarder_rad": _pick("o_custkey", 4, ["DT036", "MCC00 ,XX", None, "dt037,DT0371"]),
    "barnets_diagnoser_rad": _pick("o_orderkey", 7, ["P210", "P240,P704A", "P140", None, "P612 , P808", "P704", "P149,P709"]),
    "barnets_atgarder_rad": _pick("o_custkey", 3, ["DV034", "DV0341", None]),
    "ventilation_pa_mask_min": _pick("o_orderkey", 4, ["2", "", None, " "]),
    "intubation_min": _pick("o_orderkey", 10, ["1", None, None, "", "", None, "", None, "", None]),
    "hjartmassage_min": _pick("o_custkey", 10, [None, None, "1", "", "", None, "", None, "", None]),
}

# A neonatal registry in its raw text form, one row per order line.
RAW_NEONATAL = {
    "glopnr": "CASE WHEN l_orderkey % 19 = 0 THEN '' WHEN l_linenumber % 2 = 0 THEN CAST(l_orderkey AS STRING) || '.0' "
    "ELSE ' ' || CAST(l_orderkey AS STRING) END",
    "Högst HIE": _pick("l_partkey", 5, ["0", "1", "2,0", None, "x"]),
    "HIE": _pick("l_suppkey", 4, ["Ja", "Nej", None, "?"]),
    "ICD_kod": _pick("l_partkey", 6, ["P10;P90", "p523 ; P36", None, "P392", "P391", "XP10"]),
    "KVÅ_kod": _pick("l_suppkey", 5, ["DG021", "dg0220;AA", "DG0021", None, "AA;DG022"]),
}


def _raw_sql(cells: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in cells.items()) + f" FROM {source}"


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread_scan(table(spark, sf_dir, "orders"))
    return orders.selectExpr(*[f"{e} AS `{n}`" for n, e in RAW_REGISTRY.items()])


def raw_neonatal(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spread_scan(table(spark, sf_dir, "lineitem"))
    return lines.selectExpr(*[f"{e} AS `{n}`" for n, e in RAW_NEONATAL.items()])


def _codes(column: str, delimiter: str) -> str:
    return f"""string_split(replace(upper(coalesce("{column}", '')), ' ', ''), '{delimiter}')"""


def _rule_sql(column: str, kind: str, codes: list[str], delimiter: str = ",") -> str:
    if kind == "exact":
        return f"list_has_any({_codes(column, delimiter)}, {codes})"
    return f"len([x FOR x IN {_codes(column, delimiter)} IF regexp_full_match(x, '({'|'.join(codes)})[A-Z0-9]*')]) > 0"


_INT_SQL = "TRY_CAST(replace({}, ',', '.') AS INTEGER)"
_NUM_SQL = "TRY_CAST(replace({}, ',', '.') AS DOUBLE)"
_YES_NO_SQL = "CASE lower({}) WHEN 'ja' THEN TRUE WHEN 'nej' THEN FALSE END"
_TEXT_OUT = [
    c for c in registry.REGISTRY_COLUMNS
    if c not in ("BabyID", "langd_inskrivning_cm", "bmi_inskrivning", "ph_navelartar", "ph_navelven")
]

_INDICATOR_SQL = ", ".join(
    "(" + " OR ".join(_rule_sql(registry.CODE_SOURCES[s], kind, codes) for s, kind, codes in rules) + f") AS {name}"
    for name, rules in registry.CODE_RULES.items()
)
_NEONATAL_SQL = ", ".join(
    f"bool_or({_rule_sql(column, 'prefix', codes, ';')}) AS {name}"
    for name, (column, codes) in registry.NEONATAL_RULES.items()
)

REGISTRY_CTES = f"""
reg_raw AS ({_raw_sql(RAW_REGISTRY, "orders")}),
reg_cells AS (SELECT nullif(trim(COLUMNS(*)), '') FROM reg_raw),
reg_dates AS (
    SELECT *, regexp_replace(personnummer_mor, '[^0-9]', '', 'g') AS digits,
           TRY_CAST(forlossningsdatum_fv1 AS DATE) AS birth_day, {_INT_SQL.format("forlossningstid_fv1")} AS birth_time_seconds,
           TRY_CAST(etablerade_varkar_datum AS DATE) AS labour_day, {_INT_SQL.format("etablerade_varkar_tid")} AS labour_seconds,
           TRY_CAST(avled_datum AS DATE) AS death_day
    FROM reg_cells),
reg AS (
    SELECT regexp_replace(glopnr, '\\.0+$', '') AS glopnr,
           substr(digits, 1, 8) || '-' || substr(digits, 9, 4) AS "PatientID",
           birth_day, birth_time_seconds, CAST(birth_day AS TIMESTAMP) + to_seconds(CAST(birth_time_seconds AS BIGINT)) AS birth_timestamp,
           CASE WHEN strftime(birth_day, '%m-%d') < substr(digits, 5, 2) || '-' || substr(digits, 7, 2) THEN -1 ELSE 0 END
               + year(birth_day) - year(CAST(try_strptime(substr(digits, 1, 8), '%Y%m%d') AS DATE)) AS maternal_age,
           labour_day AS etablerade_varkar_datum, labour_seconds AS etablerade_varkar_tid,
           CAST(labour_day AS TIMESTAMP) + to_seconds(CAST(labour_seconds AS BIGINT)) AS etablerade_varkar_timestamp,
           86400 * (birth_day - labour_day) + birth_time_seconds - labour_seconds AS etablerade_varkar_seconds,
           forlossningsstart_basta_skattning AS forlossningsstart, forlossningsslut_basta_skattning AS forlossningsslut,
           {_INT_SQL.format("apgar_1_min")} AS apgar1, {_INT_SQL.format("apgar_5_min")} AS apgar5, {_INT_SQL.format("apgar_10_min")} AS apgar10,
           7 * {_INT_SQL.format("gl_v_barn")} + {_INT_SQL.format("gl_d_barn")} AS gestational_days,
           fodelseland, utbildningsniva, {_INT_SQL.format("para_mhv1")} AS para_mhv1,
           {_NUM_SQL.format("langd_inskrivning_cm")} AS langd_inskrivning_cm, {_NUM_SQL.format("bmi_inskrivning")} AS bmi_inskrivning,
           coalesce(lower(tidigare_sectio), '') = 'ja' AS previous_c_section,
           tobak_3_manader_fore_graviditet, tobak_inskrivning, tobak_vecka_30_32,
           lower(concat_ws('|', tobak_3_manader_fore_graviditet, tobak_inskrivning, tobak_vecka_30_32)) LIKE '%cigg%' AS is_smoker,
           {_YES_NO_SQL.format("diabetes_mellitus")} AS diabetes_mellitus,
           CASE WHEN kon = 'Flicka' THEN kon WHEN kon IS NOT NULL THEN 'Pojke' END AS child_sex, kon = 'Flicka' AS is_girl,
           {_INT_SQL.format("alkohol_audit_poang")} AS alkohol_audit_poang,
           {_NUM_SQL.format("ph_navelartar")} AS ph_navelartar, {_NUM_SQL.format("ph_navelven")} AS ph_navelven,
           coalesce({_NUM_SQL.format("ph_navelartar")}, {_NUM_SQL.format("ph_navelven")}) < 7 AS ph_navel_below7,
           death_day AS avled_datum, CASE WHEN death_day - birth_day BETWEEN 0 AND 28 THEN death_day - birth_day END AS died_after_days,
           {_INDICATOR_SQL},
           ventilation_pa_mask_min IS NOT NULL OR intubation_min IS NOT NULL OR hjartmassage_min IS NOT NULL AS resuscitated
    FROM reg_dates WHERE length(digits) >= 12 AND birth_day IS NOT NULL),
neo_raw AS ({_raw_sql(RAW_NEONATAL, "lineitem")}),
neo_cells AS (SELECT nullif(trim(COLUMNS(*)), '') FROM neo_raw),
neo AS (
    SELECT regexp_replace(glopnr, '\\.0+$', '') AS glopnr, max({_INT_SQL.format('"Högst HIE"')}) AS highest_hie,
           bool_or({_YES_NO_SQL.format('"HIE"')}) AS hie, {_NEONATAL_SQL}
    FROM neo_cells WHERE glopnr IS NOT NULL GROUP BY 1),
enriched AS (
    SELECT r.*, n.highest_hie, n.hie, n.intracranial_haemorrhage, n.neonatal_convulsions, n.neonatal_sepsis_or_pneumonia,
           CASE WHEN r.resuscitated THEN TRUE ELSE n.respiratorbehandling END AS respiratorbehandling
    FROM reg r LEFT JOIN neo n ON r.glopnr = n.glopnr WHERE r.apgar5 IS NOT NULL)"""


def _out_sql() -> str:
    parts = []
    for c in registry.REGISTRY_COLUMNS[1:]:
        parts.append(f"CAST({c} AS VARCHAR) AS {c}" if c in _TEXT_OUT else c)
    return ", ".join(parts)


@query("registry_parse", f'WITH {REGISTRY_CTES} SELECT glopnr, "PatientID", {_out_sql()} FROM enriched')
def registry_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = enriched_registry(raw_registry(spark, sf_dir), raw_neonatal(spark, sf_dir))
    return as_text(people.select("glopnr", "PatientID", *registry.REGISTRY_COLUMNS[1:]), *_TEXT_OUT)


@query(
    "neonatal_aggregate",
    f"""WITH {REGISTRY_CTES} SELECT glopnr, CAST(highest_hie AS VARCHAR) AS highest_hie, CAST(hie AS VARCHAR) AS hie,
        intracranial_haemorrhage, neonatal_convulsions, neonatal_sepsis_or_pneumonia, respiratorbehandling FROM neo""",
)
def neonatal_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_text(registry.parse_neonatal(raw_neonatal(spark, sf_dir)), "highest_hie", "hie")


RECORDINGS_SQL = f"""
recordings AS (
    SELECT DISTINCT l.l_orderkey AS "BabyID", CAST(l.l_shipdate AS DATE) AS ctg_date,
           substr(regexp_replace(p.personnummer_mor, '[^0-9]', '', 'g'), 1, 8) || '-' || substr(regexp_replace(p.personnummer_mor, '[^0-9]', '', 'g'), 9, 4) AS "PatientID"
    FROM lineitem l JOIN (SELECT o_orderkey, {RAW_REGISTRY["personnummer_mor"]} AS personnummer_mor FROM orders) p ON l.l_orderkey = p.o_orderkey
    WHERE p.personnummer_mor IS NOT NULL),
hits AS (
    SELECT e.*, m."BabyID", count(*) OVER (PARTITION BY e.glopnr) AS n_matches
    FROM enriched e JOIN recordings m ON e."PatientID" = m."PatientID" AND m.ctg_date IN (e.birth_day, CAST(e.birth_day - INTERVAL 1 DAY AS DATE)))"""


@query(
    "registry_match_export",
    f'WITH {REGISTRY_CTES}, {RECORDINGS_SQL} SELECT "BabyID", {_out_sql()} FROM hits WHERE n_matches = 1',
)
def registry_match_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registry, shipped lines as recordings of the same person."""
    people = enriched_registry(raw_registry(spark, sf_dir), raw_neonatal(spark, sf_dir))
    owners = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS BabyID", f"{RAW_REGISTRY['personnummer_mor']} AS personnummer_mor"
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("BabyID"), F.col("l_shipdate").cast("date").alias("ctg_date")
    )
    person = text.person_key(text.digits_only(F.col("personnummer_mor"))).alias("PatientID")
    owned = dealt(lines, "BabyID").join(dealt(owners.dropna(), "BabyID"), "BabyID")
    dated = owned.select("BabyID", "ctg_date", person)
    recordings = matching.recording_map(dated, "BabyID", "PatientID", "ctg_date")
    single = matching.unique_matches(people, recordings, "PatientID", "birth_day", "BabyID", "ctg_date")
    return as_text(single.select(*registry.REGISTRY_COLUMNS), *_TEXT_OUT)


@query(
    "registry_people",
    f"""WITH raw AS (SELECT regexp_replace({RAW_REGISTRY["personnummer_mor"]}, '[^0-9]', '', 'g') AS d FROM orders)
    SELECT DISTINCT substr(d, 1, 8) || '-' || substr(d, 9, 4) AS "PatientID" FROM raw WHERE length(d) >= 12""",
)
def registry_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.registry_people(raw_registry(spark, sf_dir))
