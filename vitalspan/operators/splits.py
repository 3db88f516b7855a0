"""Labels and repeatable stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.config import SplitSettings
from vitalspan.functions.keys import hex_prefix, stable_order
from vitalspan.operators.cells import position_in_group
from vitalspan.operators.skew import join_per_key

SPLITS = ["train", "val", "test"]


def at_risk(score: Column, at_risk_max: int) -> Column:
    return (score <= at_risk_max).cast("int")


def labels(registry: DataFrame, at_risk_max: int, key: str = "BabyID", score: str = "apgar5") -> DataFrame:
    """Key, score and binary target of the rows that have both key and score."""
    typed = registry.select(key, F.col(score).try_cast("double").cast("int").alias(score)).dropna()
    return typed.withColumn("target", at_risk(F.col(score), at_risk_max))


def label_summary(labelled: DataFrame) -> DataFrame:
    counted = labelled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("target") == 0).alias("n_healthy"),
        F.count_if(F.col("target") == 1).alias("n_at_risk"),
    )
    return counted.withColumn("at_risk_pct", F.try_divide(F.col("n_at_risk") * 100.0, F.col("n_rows")))


def stratified_split(
    labelled: DataFrame, settings: SplitSettings, key: str = "BabyID", target: str = "target"
) -> DataFrame:
    """Add ``split``: each class is cut at the fractions in a repeatable shuffled order.

    The order is a digest of seed and key.  Positions are counted bucket by bucket of
    the digest, so a class that holds nearly all rows is never ranked in one task.
    """
    ordered = labelled.withColumn("_order", stable_order(F.col(key), settings.random_seed))
    placed = position_in_group(
        ordered, [target], hex_prefix(F.col("_order")), [F.col("_order"), F.col(key)], "_position"
    )
    sizes = labelled.groupBy(target).agg(F.count(F.lit(1)).alias("_size"))
    sized = join_per_key(placed, sizes, target, spread_by=["_order"])

    def cut(fraction: float) -> Column:
        return F.floor(F.col("_size") * F.lit(fraction) + F.lit(0.5))

    split = (
        F.when(F.col("_position") <= cut(settings.train_fraction), "train")
        .when(F.col("_position") <= cut(settings.train_fraction + settings.val_fraction), "val")
        .otherwise("test")
    )
    return sized.select(*labelled.columns, split.alias("split"))


def split_summary(splits: DataFrame, target: str = "target") -> DataFrame:
    return splits.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(target).alias("n_positive"),
        (F.sum(target) * 100.0 / F.count(F.lit(1))).alias("positive_pct"),
    )
