"""Birth registry and neonatal registry: text columns to typed, nullable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.functions import dates, text

# Columns of the exported registry table, in order.
REGISTRY_COLUMNS = [
    "BabyID", "birth_day", "birth_time_seconds", "birth_timestamp", "maternal_age",
    "etablerade_varkar_datum", "etablerade_varkar_tid", "etablerade_varkar_timestamp", "etablerade_varkar_seconds",
    "forlossningsstart", "forlossningsslut", "apgar1", "apgar5", "apgar10", "gestational_days",
    "fodelseland", "utbildningsniva", "para_mhv1", "langd_inskrivning_cm", "bmi_inskrivning", "previous_c_section",
    "tobak_3_manader_fore_graviditet", "tobak_inskrivning", "tobak_vecka_30_32", "is_smoker", "diabetes_mellitus",
    "child_sex", "is_girl", "alkohol_audit_poang", "ph_navelartar", "ph_navelven", "ph_navel_below7",
    "avled_datum", "died_after_days", "gestational_hypertension_without_significant_proteinuria", "preeclampsia",
    "gestational_or_pregestational_diabetes", "uterine_rupture", "sepsis", "placental_abruption",
    "heavy_vaginal_bleeding_before_or_during_delivery", "umbilical_cord_prolapse", "shoulder_dystocia",
    "labor_dystocia", "use_of_oxytocin", "severe_birth_asphyxia", "meconium_aspiration_syndrome",
    "treatment_for_hypoglycemia", "neonatal_anemia", "highest_hie", "hie", "intracranial_haemorrhage",
    "neonatal_convulsions", "neonatal_sepsis_or_pneumonia", "respiratorbehandling",
]

# Diagnosis and procedure codes behind each indicator.
# (source, rule, codes); an indicator is true when any of its rules holds.
CODE_RULES: dict[str, list[tuple[str, str, list[str]]]] = {
    "gestational_hypertension_without_significant_proteinuria": [("mother_dx", "prefix", ["O13", "O16"])],
    "preeclampsia": [("mother_dx", "prefix", ["O14", "O15"])],
    "gestational_or_pregestational_diabetes": [("mother_dx", "prefix", ["O24"])],
    "uterine_rupture": [("mother_dx", "exact", ["O710", "O711"]), ("mother_px", "exact", ["MCC00"])],
    "sepsis": [("mother_dx", "prefix", ["A41"])],
    "placental_abruption": [("mother_dx", "exact", ["O711"])],
    "heavy_vaginal_bleeding_before_or_during_delivery": [("mother_dx", "prefix", ["O46", "O67"])],
    "umbilical_cord_prolapse": [("mother_dx", "exact", ["O690"])],
    "shoulder_dystocia": [
        ("mother_dx", "prefix", ["O66"]),
        ("child_dx", "exact", ["P140", "P141", "P143", "P148", "P149"]),
    ],
    "labor_dystocia": [("mother_dx", "exact", ["O620", "O621", "O628", "O629"])],
    "use_of_oxytocin": [("mother_px", "exact", ["DT036", "DT037"])],
    "severe_birth_asphyxia": [("child_dx", "exact", ["P210", "P808", "P809"]), ("child_px", "exact", ["DV034"])],
    "meconium_aspiration_syndrome": [("child_dx", "exact", ["P240"])],
    "treatment_for_hypoglycemia": [("child_dx", "exact", ["P703", "P704A", "P704B", "P708", "P709"])],
    "neonatal_anemia": [("child_dx", "exact", ["P612", "P613", "P614"])],
}
CODE_SOURCES = {
    "mother_dx": "moderns_diagnoser_rad",
    "mother_px": "moderns_atgarder_rad",
    "child_dx": "barnets_diagnoser_rad",
    "child_px": "barnets_atgarder_rad",
}
NEONATAL_RULES = {
    "intracranial_haemorrhage": ("ICD_kod", ["P10", "P52"]),
    "neonatal_convulsions": ("ICD_kod", ["P90"]),
    "neonatal_sepsis_or_pneumonia": ("ICD_kod", ["P23", "P36", "P392"]),
    "respiratorbehandling": ("KVÅ_kod", ["DG021", "DG022", "DG0002"]),
}
SMOKING_COLUMNS = ["tobak_3_manader_fore_graviditet", "tobak_inskrivning", "tobak_vecka_30_32"]
RESUSCITATION_COLUMNS = ["ventilation_pa_mask_min", "intubation_min", "hjartmassage_min"]
SMOKING_FRAGMENT = "cigg"
ACIDOSIS_LIMIT = 7.0
DEATH_WINDOW_DAYS = (0, 28)


def _any(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out | flag
    return out


def indicator(rules: list[tuple[str, str, list[str]]]) -> Column:
    tests = {"prefix": text.has_code_prefix, "exact": text.has_code}
    return _any([tests[kind](F.col(f"_{source}"), codes) for source, kind, codes in rules])


NUMERIC_COLUMNS = [
    "forlossningstid_fv1", "etablerade_varkar_tid", "apgar_1_min", "apgar_5_min", "apgar_10_min", "gl_v_barn",
    "gl_d_barn", "para_mhv1", "langd_inskrivning_cm", "bmi_inskrivning", "alkohol_audit_poang", "ph_navelartar", "ph_navelven",
]


def parse_registry(raw: DataFrame) -> DataFrame:
    """Usable registry rows: twelve digits of person number, a birth day and a five-minute score.

    Two levels of columns, each with array functions over cells of one kind: Spark compiles
    such a level to many small methods.  Without them all levels become one generated
    method, too long for the JVM's JIT, which is interpreted row by row.  The flag of usable
    rows leaves through a generator of one row: a filter on it is not pushed below, where it
    would parse the same cells again, on the few splits of a small file.
    """
    c = F.col
    staged = raw.where(c("personnummer_mor").isNotNull()).withColumns(
        {
            "_digits": text.digits_only(c("personnummer_mor")),
            "_birth": text.text_date(c("forlossningsdatum_fv1")),
            "_labour": text.text_date(c("etablerade_varkar_datum")),
            "_death": text.text_date(c("avled_datum")),
            "_sex": text.clean_text(c("kon")),
            "_codes": F.transform(F.array(*[c(column) for column in CODE_SOURCES.values()]), text.code_list),
            **{f"_n_{column}": text.comma_double(c(column)) for column in NUMERIC_COLUMNS},
        }
    )

    staged = staged.withColumns({f"_{short}": F.get("_codes", F.lit(i)) for i, short in enumerate(CODE_SOURCES)})

    def whole(column: str) -> Column:
        return text.rounded_int(c(f"_n_{column}"))

    birth_ts = dates.date_with_seconds(c("_birth"), whole("forlossningstid_fv1"))
    labour_ts = dates.date_with_seconds(c("_labour"), whole("etablerade_varkar_tid"))
    girl = c("_sex") == "Flicka"
    typed = {
        "glopnr": text.join_key(c("glopnr")),
        "PatientID": text.person_key(c("_digits")),
        "birth_day": c("_birth"),
        "birth_time_seconds": whole("forlossningstid_fv1"),
        "birth_timestamp": birth_ts,
        "maternal_age": dates.completed_years(dates.date_from_digits(c("_digits")), c("_birth")),
        "etablerade_varkar_datum": c("_labour"),
        "etablerade_varkar_tid": whole("etablerade_varkar_tid"),
        "etablerade_varkar_timestamp": labour_ts,
        "etablerade_varkar_seconds": dates.seconds_between(labour_ts, birth_ts),
        "forlossningsstart": text.clean_text(c("forlossningsstart_basta_skattning")),
        "forlossningsslut": text.clean_text(c("forlossningsslut_basta_skattning")),
        "apgar1": whole("apgar_1_min"),
        "apgar5": whole("apgar_5_min"),
        "apgar10": whole("apgar_10_min"),
        "gestational_days": whole("gl_v_barn") * 7 + whole("gl_d_barn"),
        "fodelseland": text.clean_text(c("fodelseland")),
        "utbildningsniva": text.clean_text(c("utbildningsniva")),
        "para_mhv1": whole("para_mhv1"),
        "langd_inskrivning_cm": c("_n_langd_inskrivning_cm"),
        "bmi_inskrivning": c("_n_bmi_inskrivning"),
        "previous_c_section": F.coalesce(text.yes_no(c("tidigare_sectio")), F.lit(False)),
        **{name: text.clean_text(c(name)) for name in SMOKING_COLUMNS},
        "is_smoker": F.exists(F.array(*SMOKING_COLUMNS), lambda x: text.mentions(x, SMOKING_FRAGMENT)),
        "diabetes_mellitus": text.yes_no(c("diabetes_mellitus")),
        "child_sex": F.when(girl, "Flicka").when(c("_sex").isNotNull(), "Pojke"),
        "is_girl": girl,
        "alkohol_audit_poang": whole("alkohol_audit_poang"),
        "ph_navelartar": c("_n_ph_navelartar"),
        "ph_navelven": c("_n_ph_navelven"),
        "ph_navel_below7": F.coalesce("_n_ph_navelartar", "_n_ph_navelven") < ACIDOSIS_LIMIT,
        "avled_datum": c("_death"),
        "died_after_days": dates.days_if_within(c("_birth"), c("_death"), *DEATH_WINDOW_DAYS),
        **{name: indicator(rules) for name, rules in CODE_RULES.items()},
        "resuscitated": F.exists(F.array(*RESUSCITATION_COLUMNS), lambda x: text.clean_text(x).isNotNull()),
    }
    usable = (F.length("_digits") >= 12) & c("_birth").isNotNull() & whole("apgar_5_min").isNotNull()
    flagged = staged.withColumn("_flag", usable)
    rows = flagged.withColumn("_usable", F.explode(F.array("_flag"))).where("_usable")
    return rows.select(*[column.alias(name) for name, column in typed.items()])


def parse_neonatal(raw: DataFrame) -> DataFrame:
    """One row per registration key: worst grade and any-of flags over its records."""
    keyed = raw.select(
        text.join_key(F.col("glopnr")).alias("glopnr"),
        text.comma_int(F.col("Högst HIE")).alias("highest_hie"),
        text.yes_no(F.col("HIE")).alias("hie"),
        *[text.code_list(F.col(c)).alias(c) for c in sorted({c for c, _ in NEONATAL_RULES.values()})],
    ).where(F.col("glopnr").isNotNull())
    return keyed.groupBy("glopnr").agg(
        F.max("highest_hie").alias("highest_hie"),
        F.bool_or("hie").alias("hie"),
        *[
            F.bool_or(text.has_code_prefix(F.col(column), prefixes, ";")).alias(name)
            for name, (column, prefixes) in NEONATAL_RULES.items()
        ],
    )


def enrich(registry: DataFrame, neonatal: DataFrame) -> DataFrame:
    """Registry rows with the neonatal columns; ventilation is true if either source says so."""
    joined = registry.join(neonatal, "glopnr", "left")
    treated = F.when(F.col("resuscitated"), F.lit(True)).otherwise(F.col("respiratorbehandling"))
    return joined.withColumn("respiratorbehandling", treated).drop("resuscitated")
