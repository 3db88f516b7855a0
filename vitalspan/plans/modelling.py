"""Modelling tables: labels, splits, features, sequences, encoded inputs, baseline classifier."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.config import BaselineSettings, StudySettings
from vitalspan.operators import features, metrics, quality, sequences, splits, tabular
from vitalspan.operators.quantiles import exact_quantiles
from vitalspan.sources import sinks, tables


def load_splits(spark: SparkSession, settings: StudySettings, registry_csv: str, splits_path: str) -> DataFrame:
    """The stored splits, made first when there are none or their writing was not finished."""
    if not tables.path_exists(spark, f"{splits_path.rstrip('/')}/_SUCCESS"):
        registry = tables.read_text_csv(spark, registry_csv, ",").select("BabyID", "apgar5")
        labelled = quality.require_unique(splits.labels(registry, settings.at_risk_max_apgar), "BabyID")
        made = splits.stratified_split(labelled, settings.split)
        sinks.write_ordered_csv(made, splits_path, ["split", "BabyID"])
    stored = tables.read_text_csv(spark, splits_path, ",")
    return stored.select("BabyID", F.col("apgar5").cast("int"), F.col("target").cast("int"), "split")


def baseline_dataset(split_table: DataFrame, series: DataFrame) -> DataFrame:
    """Split rows with the aggregate features of their series; reading fails for a subject without any."""
    own = series.join(split_table.select("BabyID"), "BabyID", "left_semi")
    found = features.as_model_types(features.aggregate_features(own, bounded=True))
    joined = split_table.join(found, "BabyID", "left")
    failure = F.raise_error(F.concat(F.lit("no series for subject "), F.col("BabyID").cast("string"))).cast("boolean")
    return joined.where(F.when(F.col("n_rows").isNull(), failure).otherwise(F.lit(True)))


@dataclass(frozen=True)
class BaselineModel:
    """Median fill, scaling and a class-balanced logistic regression."""

    columns: list[str]
    medians: dict[str, float]
    moments: dict[str, tuple[float, float]]
    model: LogisticRegressionModel

    def score(self, rows: DataFrame, keep: Sequence[str], name: str = "score") -> DataFrame:
        prepared = _scaled_vector(rows, self.columns, self.medians, self.moments)
        scored = self.model.transform(prepared)
        return scored.select(*keep, vector_to_array("probability")[1].alias(name))


def _filled(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    return rows.withColumns(
        {c: F.coalesce(tabular.as_number(F.col(c)), F.lit(m)) for c, m in medians.items()}
    )


def _scaled_vector(
    rows: DataFrame, columns: list[str], medians: dict[str, float], moments: dict[str, tuple[float, float]]
) -> DataFrame:
    filled = _filled(rows, medians)
    scaled = filled.withColumns({f"_z_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in moments.items()})
    return VectorAssembler(inputCols=[f"_z_{c}" for c in columns], outputCol="features").transform(scaled)


def fit_baseline(
    train: DataFrame, columns: Sequence[str], target: str = "target", settings: BaselineSettings | None = None
) -> BaselineModel:
    """Minimise C * sum of balanced losses + half the squared weights.

    Balanced weights sum to the number of rows, so the penalty per mean loss is 1/(C n).
    """
    settings = settings or BaselineSettings()
    columns = list(columns)
    middle = exact_quantiles(train, [], {c: (c, 0.5) for c in columns}).first()
    medians = {c: float(middle[c]) for c in columns if middle[c] is not None}
    columns = [c for c in columns if c in medians]
    moments = tabular.feature_moments(_filled(train, medians), columns)
    counts = {r[target]: r["count"] for r in train.groupBy(target).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(target) == 1, n / (2 * counts[1])).otherwise(n / (2 * counts[0]))
    prepared = _scaled_vector(train, columns, medians, moments).withColumn("_weight", weight)
    estimator = LogisticRegression(
        featuresCol="features",
        labelCol=target,
        weightCol="_weight",
        regParam=1.0 / (settings.logreg_c * n),
        elasticNetParam=0.0,
        maxIter=settings.max_iter,
        tol=1e-9,
        standardization=False,
    )
    return BaselineModel(columns, medians, moments, estimator.fit(prepared))


def run_baseline(dataset: DataFrame, settings: BaselineSettings | None = None) -> tuple[BaselineModel, DataFrame]:
    """Fit on train, tune the threshold on val, report val and test."""
    columns = [c for c in dataset.columns if c not in {"BabyID", "split", "apgar5", "target"}]
    model = fit_baseline(dataset.where(F.col("split") == "train"), columns, settings=settings)
    scored = model.score(dataset, ["BabyID", "split", "target"])
    val, test = (scored.where(F.col("split") == s) for s in ("val", "test"))
    tuned = float(metrics.best_f1_threshold(val, "target", "score").first()["threshold"])
    parts = [("val", val, tuned), ("test_val_tuned", test, tuned), ("test_default_0.5", test, 0.5)]
    report = None
    for name, rows, threshold in parts:
        line = metrics.binary_metrics(rows, "target", "score", threshold).select(F.lit(name).alias("split"), "*")
        report = line if report is None else report.unionByName(line)
    return model, report


def sequence_tables(series: DataFrame, split_table: DataFrame, settings: StudySettings) -> DataFrame:
    """Sequences of all split subjects with their split and target."""
    built = sequences.model_sequences(
        series.join(split_table.select("BabyID"), "BabyID", "left_semi"), settings.sequence
    )
    return split_table.join(built, "BabyID")


def multimodal_tables(series: DataFrame, registry: DataFrame, split_table: DataFrame, settings: StudySettings) -> DataFrame:
    """Sequences, encoded and scaled tabular inputs, targets and masks, one row per subject."""
    reg = settings.registry
    merged = tabular.merge_splits(split_table.select("BabyID", "split"), tabular.clean_inputs(registry, reg))
    train = merged.where(F.col("split") == "train")
    encoder = tabular.fit_encoder(
        train,
        reg.input_numeric,
        reg.input_boolean,
        reg.input_categorical,
        reg.top_k_columns,
        reg.country_top_k,
        reg.categorical_other_min_frequency,
    )
    encoded = tabular.encode(merged, encoder, ["BabyID", "split"])
    moments = tabular.feature_moments(encoded.where(F.col("split") == "train"), encoder.scaled_names)
    inputs = tabular.standardise(encoded, moments)
    outputs = tabular.targets(
        merged,
        ["BabyID"],
        reg.apgar_outputs,
        tabular.output_levels(train, reg.categorical_outputs),
        reg.continuous_outputs,
        reg.binary_outputs,
        reg.binary_outputs_missing_as_false,
    )
    built = sequences.model_sequences(
        series.join(split_table.select("BabyID"), "BabyID", "left_semi"), settings.sequence
    )
    return inputs.join(outputs, "BabyID").join(built, "BabyID")
