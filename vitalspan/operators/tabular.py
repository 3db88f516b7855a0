"""Tabular inputs and targets: cleaning, encoder fitted on the training rows, masks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.config import RegistrySettings
from vitalspan.functions.arrays import clip
from vitalspan.functions.text import tidy_boolean
from vitalspan.operators.quality import require_unique
from vitalspan.operators.quantiles import exact_quantiles

MISSING = "__MISSING__"

# Texts that stand for a missing level.
MISSING_WORDS = ["", "<NA>", "nan", "None"]
MIN_DEVIATION = 1e-6


@dataclass(frozen=True)
class TabularEncoder:
    """What the training rows determine: medians, levels, and per-feature scaling."""

    numeric: tuple[str, ...]
    boolean: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: dict[str, float]
    levels: dict[str, list[str]]

    @property
    def feature_names(self) -> list[str]:
        names: list[str] = []
        for c in (*self.numeric, *self.boolean):
            names += [c, f"{c}__missing"]
        for c in self.categorical:
            names += [f"{c}__missing", *[f"{c}=={level}" for level in self.levels[c]], f"{c}__other"]
        return names

    @property
    def scaled_names(self) -> list[str]:
        return [*self.numeric, *self.boolean]


def as_number(c: Column) -> Column:
    """Text or number to double; unreadable text and NaN give NULL."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def as_level(c: Column) -> Column:
    trimmed = F.trim(c.cast("string"))
    return F.when(~trimmed.isin(MISSING_WORDS), trimmed)


def clean_inputs(registry: DataFrame, settings: RegistrySettings, key: str = "BabyID") -> DataFrame:
    """Typed model inputs and outputs of the exported registry table, one row per key."""
    numbers = [*settings.input_numeric, *settings.apgar_outputs, *settings.continuous_outputs]
    flags = [*settings.input_boolean, *settings.binary_outputs]
    levels = [*settings.input_categorical, *settings.categorical_outputs]
    typed = {c: as_number(F.col(c)) for c in numbers}
    typed |= {c: tidy_boolean(F.col(c)) for c in flags}
    typed |= {c: as_level(F.col(c)) for c in levels}
    if "langd_inskrivning_cm" in typed:
        height = typed["langd_inskrivning_cm"]
        typed["langd_inskrivning_cm"] = F.when(height > 0, height)
    return require_unique(registry.select(key, *[c.alias(n) for n, c in typed.items()]), key)


def level_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count per (column, level), missing values counted as their own level."""
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("level"))
            for c in columns
        ]
    )
    exploded = train.select(F.explode(cells).alias("cell")).select("cell.*")
    return exploded.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n_rows"))


def kept_levels(counts: DataFrame, top_k_columns: Sequence[str], top_k: int, min_frequency: int) -> DataFrame:
    """Levels that get a feature of their own.

    The top-k columns keep their most frequent levels, counting the missing level
    before it is discarded; the others keep every level that is frequent enough.
    """
    is_top_k = F.col("column").isin(list(top_k_columns)) if top_k_columns else F.lit(False)
    by_count = Window.partitionBy("column").orderBy(F.col("n_rows").desc(), F.col("level"))
    top = counts.where(is_top_k).withColumn("_place", F.row_number().over(by_count)).where(F.col("_place") <= top_k)
    frequent = counts.where(~is_top_k & (F.col("n_rows") >= min_frequency))
    kept = top.drop("_place").unionByName(frequent)
    return kept.where(F.col("level") != MISSING).select("column", "level", "n_rows")


def fit_encoder(
    train: DataFrame,
    numeric: Sequence[str],
    boolean: Sequence[str],
    categorical: Sequence[str],
    top_k_columns: Sequence[str] = (),
    top_k: int = 15,
    min_frequency: int = 50,
) -> TabularEncoder:
    """Fit on training rows; only medians and kept levels reach the driver."""
    medians: dict[str, float] = {}
    if numeric:
        found = exact_quantiles(train, [], {c: (c, 0.5) for c in numeric}).first()
        medians = {c: float(found[c]) if found and found[c] is not None else 0.0 for c in numeric}
    levels: dict[str, list[str]] = {c: [] for c in categorical}
    if categorical:
        kept = kept_levels(level_counts(train, categorical), top_k_columns, top_k, min_frequency)
        for row in kept.collect():
            levels[row["column"]].append(row["level"])
    return TabularEncoder(
        tuple(numeric), tuple(boolean), tuple(categorical), medians, {c: sorted(v) for c, v in levels.items()}
    )


def encode(rows: DataFrame, encoder: TabularEncoder, keep: Sequence[str]) -> DataFrame:
    """Wide float features: filled numbers, flags and levels, each with a missing mark."""
    features: dict[str, Column] = {}

    def mark(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("float")

    for c in encoder.numeric:
        features[c] = F.coalesce(F.col(c).cast("double"), F.lit(encoder.medians[c])).cast("float")
        features[f"{c}__missing"] = mark(F.col(c).isNull())
    for c in encoder.boolean:
        features[c] = mark(F.col(c))
        features[f"{c}__missing"] = mark(F.col(c).isNull())
    for c in encoder.categorical:
        known = encoder.levels[c]
        features[f"{c}__missing"] = mark(F.col(c).isNull())
        features |= {f"{c}=={level}": mark(F.col(c) == level) for level in known}
        features[f"{c}__other"] = mark(~F.col(c).isin(known)) if known else mark(F.col(c).isNotNull())
    return rows.select(*keep, *[v.alias(n) for n, v in features.items()])


def feature_moments(train: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature; a vanishing deviation counts as 1."""
    aggs = []
    for n in names:
        aggs += [F.avg(F.col(f"`{n}`").cast("double")), F.stddev_pop(F.col(f"`{n}`").cast("double"))]
    row = train.agg(*aggs).first()
    out = {}
    for i, n in enumerate(names):
        mean, std = row[2 * i] or 0.0, row[2 * i + 1] or 0.0
        out[n] = (float(mean), float(std) if std > MIN_DEVIATION else 1.0)
    return out


def standardise(rows: DataFrame, moments: dict[str, tuple[float, float]]) -> DataFrame:
    return rows.withColumns(
        {n: ((F.col(f"`{n}`") - F.lit(m)) / F.lit(s)).cast("float") for n, (m, s) in moments.items()}
    )


def output_levels(train: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct training levels of each categorical output."""
    rows = level_counts(train, columns).where(F.col("level") != MISSING).select("column", "level").collect()
    found: dict[str, list[str]] = {c: sorted(r["level"] for r in rows if r["column"] == c) for c in columns}
    for c, levels in found.items():
        if not levels:
            raise ValueError(f"no training level for {c}")
    return found


def targets(
    rows: DataFrame,
    keep: Sequence[str],
    scores: Sequence[str] = (),
    categories: dict[str, list[str]] | None = None,
    numbers: Sequence[str] = (),
    flags: Sequence[str] = (),
    missing_as_false: Sequence[str] = (),
) -> DataFrame:
    """Target and mask columns per output; masked targets are 0."""
    out: dict[str, Column] = {}

    def mask(present: Column) -> Column:
        return present.cast("float")

    for c in scores:
        out[f"y_{c}"] = F.coalesce(clip(F.col(c), 0, 10).cast("bigint"), F.lit(0))
        out[f"mask_{c}"] = mask(F.col(c).isNotNull())
    for c, levels in (categories or {}).items():
        place = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(c).cast("string"))
        index = F.when(place > 0, place - 1)
        out[f"y_{c}"] = F.coalesce(index, F.lit(0)).cast("bigint")
        out[f"mask_{c}"] = mask(index.isNotNull())
    for c in numbers:
        out[f"y_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)).cast("float")
        out[f"mask_{c}"] = mask(F.col(c).isNotNull())
    for c in flags:
        out[f"y_{c}"] = F.coalesce(F.col(c), F.lit(False)).cast("float")
        out[f"mask_{c}"] = mask(F.lit(True) if c in missing_as_false else F.col(c).isNotNull())
    return rows.select(*keep, *[v.alias(n) for n, v in out.items()])


def merge_splits(splits: DataFrame, registry: DataFrame, key: str = "BabyID") -> DataFrame:
    """Left join of two tables that both have one row per key."""
    return require_unique(splits, key).join(require_unique(registry, key), key, "left")
