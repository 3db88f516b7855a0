"""Exact classification metrics from scores, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.arrays import clip
from vitalspan.operators.cells import running_totals
from vitalspan.operators.skew import with_single_row

RANGE_SCORES = 1 << 16  # distinct scores of a range
MOST_RANGES = 4096
CHUNK_BORDERS = 64
SKETCH_SIZE = 8192
GRID_POINTS = 500
GRID_STEP = 1 / GRID_POINTS


def score_counts(rows: DataFrame, group: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score of every group; rows without group or label have no part."""
    y = F.col(label).cast("bigint")
    return rows.dropna(subset=[*group, label]).groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )


def _borders(counts: DataFrame) -> DataFrame:
    """One row: borders between ranges of about ``RANGE_SCORES`` distinct scores, in chunks, and the chunks' heads.

    The number of ranges follows the number of distinct scores; the borders come from a
    mergeable sketch, so logits and scores crowded near zero are dealt as evenly as any others.
    """
    # With the sums the subquery reads the same columns as the query, so both share one exchange.
    sketch = counts.agg(
        F.expr(f"kll_sketch_agg_double(score, {SKETCH_SIZE})").alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.sum("pos").alias("_pos_sum"), F.sum("neg").alias("_neg_sum"),
    )
    # A power of two: the sketch is asked for all borders there can be, every step-th is taken.
    wanted = F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / RANGE_SCORES))).cast("int")
    number = F.greatest(F.lit(1), F.least(F.lit(MOST_RANGES), wanted))
    shares = ",".join(str(i / MOST_RANGES) for i in range(1, MOST_RANGES))
    every = f"kll_sketch_get_quantile_double(sketch, CAST(split('{shares}', ',') AS ARRAY<DOUBLE>))"
    cut = sketch.withColumn("number", F.coalesce(number, F.lit(1)))
    cut = cut.withColumn("every", F.expr(f"CASE WHEN number > 1 THEN {every} END")).withColumn(
        "borders", F.expr(f"coalesce(transform(sequence(1, number - 1), i -> every[i * ({MOST_RANGES} div number) - 1]), CAST(array() AS ARRAY<DOUBLE>))")
    )
    cut = cut.withColumn("borders", F.when(F.col("number") > 1, F.col("borders")).otherwise(F.array().cast("array<double>")))
    chunks = f"transform(sequence(0, (size(borders) - 1) div {CHUNK_BORDERS}), c -> slice(borders, c * {CHUNK_BORDERS} + 1, {CHUNK_BORDERS}))"
    filled = cut.withColumn("_chunks", F.expr(f"CASE WHEN number > 1 THEN {chunks} ELSE array(borders) END"))
    heads = F.expr("transform(slice(_chunks, 2, size(_chunks)), c -> c[0])").alias("_heads")
    return filled.select("_chunks", heads, "_pos_sum", "_neg_sum")


def _place_among(borders: Column, score: Column) -> Column:
    """How many of the ascending borders lie below the score."""
    return F.coalesce(F.array_position(F.array_sort(F.array_append(borders, score)), score).cast("int") - 1, F.lit(0))


def _with_ranges(counts: DataFrame) -> DataFrame:
    """Add ``_range``, which rises with the score; see ``_borders``."""
    placed = with_single_row(counts, _borders(counts)).withColumn("_chunk", _place_among(F.col("_heads"), F.col("score")))
    inside = _place_among(F.get("_chunks", F.col("_chunk")), F.col("score"))
    found = F.coalesce(F.col("_chunk") * CHUNK_BORDERS + inside, F.lit(0))  # never null, so joins need not test it
    return placed.withColumn("_range", found).select(*counts.columns, "_range")


def binary_metrics(
    rows: DataFrame, label: str, score: str, threshold: float = 0.5, group: Sequence[str] = ()
) -> DataFrame:
    """One row per group: ROC-AUC, average precision, confusion counts and their ratios.

    Scores are counted per distinct value first.  ROC-AUC counts tied pairs as half;
    average precision is the step-wise sum over distinct scores.  A group with one
    class only has NULL areas.
    """
    counts = _with_ranges(score_counts(rows, group, label, score))
    ranked = running_totals(
        counts,
        group,
        F.col("_range"),
        [F.col("score").desc()],
        {"tp_at": F.col("pos"), "fp_at": F.col("neg")},
        descending_buckets=True,
    )
    hit = F.col("score") >= threshold
    sums = ranked.groupBy(*group).agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_n"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.col("neg") * (F.col("tp_at") - F.col("pos") / 2)).alias("_won"),
        F.sum(F.col("pos") * F.col("tp_at") / (F.col("tp_at") + F.col("fp_at"))).alias("_precision_sum"),
    )
    p, n, tp, fp = F.col("_p"), F.col("_n"), F.col("tp"), F.col("fp")
    both = (p > 0) & (n > 0)
    zero = F.lit(0.0)
    return sums.select(
        *group,
        F.lit(float(threshold)).alias("threshold"),
        F.when(both, F.col("_won") / (p * n)).alias("roc_auc"),
        F.when(both, F.col("_precision_sum") / p).alias("pr_auc"),
        F.coalesce(F.try_divide(tp, tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp, p), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, tp + fp + p), zero).alias("f1"),
        (n - fp).alias("tn"),
        fp.alias("fp"),
        (p - tp).alias("fn"),
        tp.alias("tp"),
        (p / (p + n)).alias("prevalence"),
    )


def _grid_index(score: Column) -> Column:
    """Index of the highest grid point not above the score."""
    guess = F.floor(score / F.lit(GRID_STEP))
    return (
        F.when((guess + 1) * F.lit(GRID_STEP) <= score, guess + 1)
        .when(guess * F.lit(GRID_STEP) > score, guess - 1)
        .otherwise(guess)
        .cast("int")
    )


def best_f1_threshold(
    rows: DataFrame, label: str, score: str, group: Sequence[str] = (), candidates: str = "distinct"
) -> DataFrame:
    """Threshold with the highest F1 per group, the lowest one on ties.

    ``candidates``: every ``distinct`` score, however many, or the 501 points of a ``grid``
    on [0, 1].  The caller chooses; the number of scores changes nothing.
    """
    if candidates not in ("distinct", "grid"):
        raise ValueError(f"unknown candidates: {candidates}")
    keys = list(group) or ["_all"]
    clipped = rows.withColumn("_score", clip(F.col(score).cast("double"), 0.0, 1.0))
    if not group:
        clipped = clipped.withColumn("_all", F.lit(0))
    counts = score_counts(clipped, keys, label, "_score")
    tried = _grid_counts(counts, keys) if candidates == "grid" else _distinct_counts(counts, keys)
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("_p"))
    known = tried.join(totals, keys) if group else with_single_row(tried, totals.drop("_all"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("_p")), F.lit(0.0))
    scored = known.withColumn("f1", f1)
    best = scored.groupBy(*keys).agg(
        F.max_by("threshold", F.struct("f1", (-F.col("threshold")).alias("low"))).alias("threshold"),
        F.max("f1").alias("f1"),
    )
    return best if group else best.drop("_all")


def _distinct_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True and false positives at every distinct score."""
    sums = {"tp": F.col("pos"), "fp": F.col("neg")}
    ranked = running_totals(
        _with_ranges(counts), keys, F.col("_range"), [F.col("score").desc()], sums, descending_buckets=True
    )
    return ranked.select(*keys, F.col("score").alias("threshold"), "tp", "fp")


def _grid_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same at the lowest grid point of each run of points that call the same rows."""
    cells = counts.groupBy(*keys, _grid_index(F.col("score")).alias("_at")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    rising = Window.partitionBy(*keys).orderBy("_at")
    above = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    lowest_equal = (F.coalesce(F.lag("_at").over(rising), F.lit(-1)) + 1) * F.lit(GRID_STEP)
    return cells.select(
        *keys, lowest_equal.alias("threshold"), F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp")
    )


def class_weights(labelled: DataFrame, target: str) -> DataFrame:
    """Positive weight of a binary target: negatives over positives (at least one)."""
    counted = labelled.agg(
        F.count_if(F.col(target) == 1).alias("n_positive"), F.count_if(F.col(target) == 0).alias("n_negative")
    )
    return counted.withColumn("pos_weight", F.col("n_negative") / F.greatest(F.col("n_positive"), F.lit(1)))


def tempered_class_weights(rows: DataFrame, target: str, power: float, group: Sequence[str] = ()) -> DataFrame:
    """(n / class count) ** power, scaled to mean 1 over the classes that occur."""
    counts = rows.dropna(subset=[target]).groupBy(*group, target).agg(F.count(F.lit(1)).alias("n_rows"))
    classes = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    raw = F.pow(F.sum("n_rows").over(classes) / F.col("n_rows"), F.lit(power))
    weighted = counts.withColumn("_raw", raw)
    return weighted.select(
        *group, target, "n_rows", (F.col("_raw") / F.avg("_raw").over(classes)).alias("weight")
    )


def error_summary(rows: DataFrame, truth: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and root mean squared error over rows where the truth is present."""
    error = F.col(prediction) - F.col(truth)
    return rows.dropna(subset=[truth]).groupBy(*group).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.count(F.lit(1)).alias("n_rows")
    )


def accuracy(rows: DataFrame, truth: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    hit = (F.col(prediction) == F.col(truth)).cast("double")
    return rows.dropna(subset=[truth]).groupBy(*group).agg(F.avg(hit).alias("accuracy"))
