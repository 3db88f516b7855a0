"""Array expressions on model scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _raised(logits: Column, use) -> Column:
    """``use`` applied to exp(logit - largest logit); shift and powers are computed once."""
    values = logits.cast("array<double>")
    pairs = F.transform(F.array(F.struct(values.alias("v"), F.array_max(values).alias("top"))), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))
    return F.transform(pairs, use)[0]


def expected_class(logits: Column) -> Column:
    """Mean class index under the softmax of the logits."""
    return _raised(logits, lambda e: _total(F.transform(e, lambda p, i: p * i)) / _total(e))


def head_mass(logits: Column, size: int) -> Column:
    """Softmax probability of the first ``size`` classes."""
    return _raised(logits, lambda e: _total(F.slice(e, 1, size)) / _total(e))


def argmax_index(values: Column) -> Column:
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
