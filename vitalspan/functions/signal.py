"""Expressions on raw signal samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample layout, plausible tocography bytes and plausible heart rates.
SAMPLES_PER_SECOND = 4
TOCO_LOW, TOCO_HIGH = 1, 99
RATE_LOW, RATE_HIGH = 30, 240


def real_number(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c.cast("double")), c)


def mean_positive(samples: Sequence[Column], integral: bool = True) -> Column:
    """Mean of the positive samples, 0 when there is none; NaN is no sample.

    Integer samples keep integer division: the fraction is dropped.
    """
    kind = "bigint" if integral else "double"
    if not integral:
        samples = [real_number(s) for s in samples]
    n = sum((F.when(s > 0, 1).otherwise(0) for s in samples), F.lit(0)).cast(kind)
    total = sum((F.when(s > 0, s).otherwise(0).cast(kind) for s in samples), F.lit(0).cast(kind))
    mean = F.call_function("div", total, n) if integral else total / n
    return F.when(n > 0, mean).otherwise(F.lit(0)).cast("float")


def base64_payload(text: Column) -> Column:
    """Decoded bytes of base64 text; NULL when the padding is wrong.

    Characters outside the alphabet are ignored before decoding.
    """
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    readable = (F.length(kept) % 4 == 0) & kept.rlike("^[A-Za-z0-9+/]*={0,2}$")
    return F.try_to_binary(F.when(readable, kept), F.lit("base64"))


def payload_bytes(payload: Column) -> Column:
    """Byte values of binary data as an array."""
    digits = F.hex(payload)
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2)),
        lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("int"),
    )
    return F.when(F.length(digits) == 0, F.array().cast("array<int>")).when(digits.isNotNull(), pairs)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def _word(payload: Column) -> Column:
    """A payload of four bytes as one number, NULL for other lengths."""
    return F.when(F.length(payload) == SAMPLES_PER_SECOND, F.conv(F.hex(payload), 16, 10).cast("bigint"))


def _four_bytes(word: Column) -> list[Column]:
    places = reversed(range(SAMPLES_PER_SECOND))
    return [F.shiftright(word, 8 * place).bitwiseAND(F.lit(255)) for place in places]


def with_toco_level(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the mean of the plausible bytes of a base64 cell, else of all its bytes, else 0.

    The usual payload of four bytes is read as one number; other lengths go through arrays.
    """
    decoded = rows.withColumn("_payload", base64_payload(F.col(text))).withColumn("_word", _word(F.col("_payload")))
    four = _four_bytes(F.col("_word"))
    fits = [b.between(TOCO_LOW, TOCO_HIGH) for b in four]
    n = sum((F.when(ok, 1).otherwise(0) for ok in fits), F.lit(0))
    chosen = sum((F.when(ok, b).otherwise(0) for ok, b in zip(fits, four, strict=True)), F.lit(0))
    of_four = F.when(n > 0, chosen / n).otherwise(sum(four, F.lit(0)) / SAMPLES_PER_SECOND)
    values = payload_bytes(F.col("_payload"))
    plausible = F.filter(values, lambda x: x.between(TOCO_LOW, TOCO_HIGH))
    of_any = F.coalesce(_mean(plausible), _mean(values), F.lit(0.0))
    level = F.when(F.col("_word").isNotNull(), of_four).otherwise(of_any).cast("float")
    return decoded.select(*rows.columns, level.alias(name))


def toco_samples(text: Column) -> Column:
    """The four byte samples of one second; four NULLs for any other payload."""
    return F.array(*[b.cast("double") for b in _four_bytes(_word(base64_payload(text)))])


def zero_as_missing(c: Column) -> Column:
    """Zero, NaN and infinite readings become NULL."""
    d = c.cast("double")
    usable = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf")) & (d != 0)
    return F.when(usable, c)


def level_flag(c: Column, level: str) -> Column:
    return F.coalesce((c == level).cast("float"), F.lit(0.0).cast("float"))


def one_hz_value(samples: Column, mode: str = "mean") -> Column:
    """One value per second out of an array of samples: skip-null mean or first."""
    values = samples.cast("array<double>")
    if mode == "first":
        return F.get(values, F.lit(0))
    if mode != "mean":
        raise ValueError(f"unknown downsampling mode: {mode}")
    return _mean(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)))
