"""Fixed-length sequences: the last N rows of each subject as left-padded arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.config import SequenceSettings
from vitalspan.functions.signal import level_flag, zero_as_missing
from vitalspan.operators.cells import CELL, with_cell
from vitalspan.operators.quantiles import exact_quantiles
from vitalspan.operators.skew import join_per_key, with_single_row


def tail_rows(
    rows: DataFrame, key: str, ts: str, n: int, cell_seconds: float = 3600, tie: Sequence[str] = ()
) -> DataFrame:
    """The last ``n`` rows of each key with ``from_end`` (0 is the last) and ``raw_len``.

    Cells are counted first; only rows in the newest cells that are needed to fill
    ``n`` are ranked, so the ranking of a key is bounded whatever its length.
    """
    cut = with_cell(rows.dropna(subset=[key, ts]), ts, cell_seconds)
    newest_first = Window.partitionBy(key).orderBy(F.col(CELL).desc())
    newer = F.coalesce(F.sum("_rows").over(newest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = (
        cut.groupBy(key, CELL)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(key, CELL, newer.alias("_newer"), F.sum("_rows").over(Window.partitionBy(key)).alias("raw_len"))
        .where(F.col("_newer") < n)
    )
    near_end = cut.join(cells.drop("_newer"), [key, CELL])
    order = Window.partitionBy(key).orderBy(F.col(ts).desc(), *[F.col(t).desc() for t in tie])
    ranked = near_end.withColumn("from_end", F.row_number().over(order) - 1).where(F.col("from_end") < n)
    return ranked.select(*rows.columns, "from_end", "raw_len")


def padded_sequences(
    rows: DataFrame,
    key: str,
    ts: str,
    steps: int,
    channels: dict[str, Column],
    padding: dict[str, float],
    padding_mask: str | None = None,
    pad_short: bool = True,
    cell_seconds: float = 3600,
    tie: Sequence[str] = (),
) -> DataFrame:
    """One row per key: raw length and one float array of ``steps`` values per channel.

    ``channels`` are expressions on the rows and ``padding`` the value in front of
    short series; ``padding_mask`` names a channel that is 1 on padding.
    """
    tail = tail_rows(rows, key, ts, steps, cell_seconds, tie)
    if not pad_short:
        tail = tail.where(F.col("raw_len") >= steps)
    item = F.struct(
        (-F.col("from_end")).alias("_at"), *[c.cast("float").alias(f"_c{i}") for i, c in enumerate(channels.values())]
    )
    grouped = tail.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"), F.max("raw_len").alias("raw_len"))
    missing = F.lit(steps) - F.size("_items")

    def filled(front: float, body: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(front).cast("float"), missing), body)

    arrays = [
        filled(padding.get(name, 0.0), F.col(f"_items._c{i}")).alias(name) for i, name in enumerate(channels)
    ]
    if padding_mask:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), F.size("_items"))
        arrays.append(filled(1.0, zeros).alias(padding_mask))
    return grouped.select(key, "raw_len", *arrays)


NAN = float("nan")


def model_sequences(
    rows: DataFrame, settings: SequenceSettings, key: str = "BabyID", ts: str = "Timestamp", quality: str = "Hr1_SignalQuality"
) -> DataFrame:
    """Signal, mask and quality channels in the settings' order; missing readings are NaN."""

    def signal(column: str, zero_is_missing: bool) -> Column:
        d = F.col(column).cast("double")
        finite = F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
        return zero_as_missing(F.col(column)) if zero_is_missing else finite

    fhr = signal("FHR", settings.treat_fhr_zero_as_missing)
    toco = signal("toco", settings.treat_toco_zero_as_missing)
    channels: dict[str, Column] = {"FHR": F.coalesce(fhr, F.lit(NAN)), "toco": F.coalesce(toco, F.lit(NAN))}
    padding = {"FHR": NAN, "toco": NAN}
    if settings.include_fhr_missing_mask:
        channels["fhr_missing_mask"] = fhr.isNull().cast("float")
        padding["fhr_missing_mask"] = 1.0
    if settings.include_toco_missing_mask:
        channels["toco_missing_mask"] = toco.isNull().cast("float")
        padding["toco_missing_mask"] = 1.0
    if settings.include_signal_quality_channels:
        for level in settings.quality_levels:
            channels[f"{quality}=={level}"] = level_flag(F.col(quality), level)
    return padded_sequences(
        rows,
        key,
        ts,
        settings.n_steps,
        channels,
        padding,
        "padding_mask" if settings.include_padding_mask else None,
        settings.pad_short,
    )


def split_sequences(rows: DataFrame, splits: DataFrame, split: str, key: str = "BabyID", ts: str = "Timestamp") -> DataFrame:
    """Rows of the subjects of one split."""
    members = splits.where(F.col("split") == split).select(key)
    return join_per_key(rows, members, key, spread_by=[ts], how="left_semi")


def length_summary(lengths: DataFrame, length: str, steps: int, pad_short: bool) -> DataFrame:
    """Counts of kept and dropped subjects and the spread of their row counts."""
    dropped = F.count_if(F.col(length) < steps) if not pad_short else F.count(F.lit(None))
    counts = lengths.agg(
        F.count(F.lit(1)).alias("n_subjects"),
        dropped.alias("n_dropped"),
        F.min(length).alias("min_rows"),
        F.max(length).alias("max_rows"),
    )
    middle = exact_quantiles(lengths, [], {"median_rows": (length, 0.5)})
    return with_single_row(counts, middle)


def signal_moments(sequences: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each signal channel over all finite steps."""
    values = F.explode(F.arrays_zip(*[F.col(c) for c in channels])).alias("step")
    steps = sequences.select(values).select("step.*")
    out = []
    for c in channels:
        finite = F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) != float("inf")), F.col(c).cast("double"))
        std = F.stddev_pop(finite)
        out += [
            F.coalesce(F.avg(finite), F.lit(0.0)).alias(f"{c}_mean"),
            F.when(std > 1e-6, std).otherwise(F.lit(1.0)).alias(f"{c}_std"),
        ]
    return steps.agg(*out)


def normalise_channels(
    sequences: DataFrame, moments: dict[str, tuple[float, float]], mask_channels: Sequence[str] = (), mask_fill: float = 0.0
) -> DataFrame:
    """Scale finite steps by (mean, deviation), set the others to 0; fill unset mask steps."""

    def scaled(c: str, mean: float, std: float) -> Column:
        return F.transform(
            F.col(f"`{c}`"),
            lambda x: F.when(F.isnan(x) | x.isNull(), F.lit(0.0)).otherwise((x - mean) / std).cast("float"),
        )

    def masked(c: str) -> Column:
        return F.transform(
            F.col(f"`{c}`"), lambda x: F.when(F.isnan(x) | x.isNull(), F.lit(mask_fill)).otherwise(x).cast("float")
        )

    return sequences.withColumns(
        {**{c: scaled(c, m, s) for c, (m, s) in moments.items()}, **{c: masked(c) for c in mask_channels}}
    )
