"""Multitask evaluation and input-removal studies over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.arrays import argmax_index, expected_class, head_mass, sigmoid
from vitalspan.operators import metrics

LOW_SCORE_LIMIT = 7


@dataclass(frozen=True)
class TaskColumns:
    """Prediction columns of one task: truth (NULL when masked) and model output."""

    name: str
    truth: str
    output: str


@dataclass(frozen=True)
class EvaluationSpec:
    scores: Sequence[TaskColumns] = ()
    categories: Sequence[TaskColumns] = ()
    numbers: Sequence[TaskColumns] = ()
    flags: Sequence[TaskColumns] = ()
    monitored: Sequence[str] = field(default_factory=tuple)


def _long(rows: DataFrame, parts: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row per (row, task) with truth and prediction, masked entries left out."""
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("task"), truth.cast("double").alias("truth"), guess.cast("double").alias("prediction")
            )
            for name, truth, guess in parts
        ]
    )
    return rows.select(F.explode(items).alias("item")).select("item.*").where(F.col("truth").isNotNull())


def expected_scores(rows: DataFrame, tasks: Sequence[TaskColumns]) -> DataFrame:
    """Truth and expected score (probability-weighted class index) per score task."""
    return _long(rows, [(t.name, F.col(t.truth), expected_class(F.col(t.output))) for t in tasks])


def low_score_risks(rows: DataFrame, tasks: Sequence[TaskColumns], limit: int = LOW_SCORE_LIMIT) -> DataFrame:
    """Truth and probability of a score below the limit per score task."""
    parts = [
        (f"{t.name}_below{limit}", (F.col(t.truth) < limit).cast("int"), head_mass(F.col(t.output), limit))
        for t in tasks
    ]
    return _long(rows, parts)


def flag_risks(rows: DataFrame, tasks: Sequence[TaskColumns]) -> DataFrame:
    return _long(rows, [(t.name, F.col(t.truth), sigmoid(F.col(t.output))) for t in tasks])


def category_guesses(rows: DataFrame, tasks: Sequence[TaskColumns]) -> DataFrame:
    return _long(rows, [(t.name, F.col(t.truth), argmax_index(F.col(t.output))) for t in tasks])


def evaluate(rows: DataFrame, spec: EvaluationSpec) -> DataFrame:
    """Long table (family, task, metric, value) of every task metric."""

    def melt(table: DataFrame, family: str, names: Sequence[str]) -> DataFrame:
        cells = F.array(
            *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
        )
        return table.select(F.lit(family).alias("family"), "task", F.explode(cells).alias("c")).select(
            "family", "task", "c.metric", "c.value"
        )

    out = []
    if spec.scores:
        errors = metrics.error_summary(expected_scores(rows, spec.scores), "truth", "prediction", ["task"])
        out.append(melt(errors, "score", ["mae", "rmse"]))
    risks = [low_score_risks(rows, spec.scores)] if spec.scores else []
    risks += [flag_risks(rows, spec.flags)] if spec.flags else []
    if risks:
        stacked = risks[0] if len(risks) == 1 else risks[0].unionByName(risks[1])
        areas = metrics.binary_metrics(stacked, "truth", "prediction", group=["task"])
        out.append(melt(areas, "binary", ["roc_auc", "pr_auc", "prevalence"]))
    if spec.categories:
        hits = metrics.accuracy(category_guesses(rows, spec.categories), "truth", "prediction", ["task"])
        out.append(melt(hits, "category", ["accuracy"]))
    if spec.numbers:
        long = _long(rows, [(t.name, F.col(t.truth), F.col(t.output)) for t in spec.numbers])
        out.append(melt(metrics.error_summary(long, "truth", "prediction", ["task"]), "number", ["mae", "rmse"]))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def monitor_value(evaluated: DataFrame, monitored: Sequence[str]) -> DataFrame:
    """Mean average precision over all binary tasks and over the monitored ones."""
    areas = evaluated.where((F.col("family") == "binary") & (F.col("metric") == "pr_auc"))
    chosen = F.when(F.col("task").isin(list(monitored)), F.col("value")) if monitored else F.lit(None).cast("double")
    means = areas.agg(F.avg("value").alias("mean_binary_pr_auc"), F.avg(chosen).alias("_chosen"))
    return means.select(
        "mean_binary_pr_auc", F.coalesce("_chosen", "mean_binary_pr_auc").alias("monitor_binary_pr_auc")
    )


def removal_deltas(runs: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Runs (seed, ablation, outcome, metric, value) against the baseline run of their seed."""
    keys = ["seed", "outcome", "metric"]
    base = runs.where(F.col("ablation") == baseline).select(*keys, F.col("value").alias("baseline_value"))
    joined = runs.join(base, keys)
    return joined.withColumn("drop_value", F.col("baseline_value") - F.col("value"))


def removal_summary(deltas: DataFrame) -> DataFrame:
    """Mean drop and its sample deviation over seeds; one seed has deviation 0."""
    drop = F.col("drop_value")
    n = F.count(drop)
    return deltas.groupBy("ablation", "outcome", "metric").agg(
        F.avg(drop).alias("mean_drop"),
        F.when(n > 1, F.stddev_samp(drop)).when(n == 1, F.lit(0.0)).alias("sd_drop"),
        n.alias("n_seeds"),
    )


def removal_ranking(summary: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Place of each removal per outcome and metric, largest mean drop first."""
    order = Window.partitionBy("outcome", "metric").orderBy(F.col("mean_drop").desc_nulls_last(), "ablation")
    return summary.where(F.col("ablation") != baseline).withColumn("place", F.row_number().over(order))


def features_of(feature_names: Sequence[str], raw_columns: Sequence[str]) -> list[str]:
    """Encoded feature names that stem from the given raw columns."""
    raw = set(raw_columns)

    def origin(name: str) -> str:
        for mark in ("==", "__missing", "__other"):
            head, found, _ = name.partition(mark)
            if found:
                return head
        return name

    return [n for n in feature_names if origin(n) in raw]


def remove_features(rows: DataFrame, feature_names: Sequence[str], raw_columns: Sequence[str], means: dict[str, float]) -> DataFrame:
    """Replace the features of the raw columns by their training means."""
    hit = features_of(feature_names, raw_columns)
    if not hit:
        raise ValueError(f"no encoded feature stems from {list(raw_columns)}")
    return rows.withColumns({n: F.lit(means[n]) for n in hit})


def remove_sequences(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Replace every step of the channels by zero."""
    return rows.withColumns(
        {c: F.transform(F.col(f"`{c}`"), lambda x: F.lit(0.0).cast("float")) for c in channels}
    )
