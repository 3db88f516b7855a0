"""A bitmap of keys, tested on the rows of the large side before they are shuffled.

The bitmap has a fixed size, whatever the number of keys, and reaches the tasks as a
scalar subquery.  It never drops a row with a partner: a full bitmap only keeps more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BITS = 64
CHUNK_WORDS = 512
BITMAP_BITS = 1 << 24  # 2 MB


def _place(on: Sequence[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bits))


def key_bitmap(keys: DataFrame, on: Sequence[Column], bits: int = BITMAP_BITS) -> DataFrame:
    """One row with the bitmap: chunks of 64-bit words, empty chunks without words."""
    place = _place(on, bits)
    words = keys.select((F.floor(place / WORD_BITS)).alias("word"), (place % WORD_BITS).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")
    )
    chunks = words.groupBy(F.floor(F.col("word") / CHUNK_WORDS).alias("chunk")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("word") % CHUNK_WORDS).cast("int").alias("at"), "bits"))).alias("set")
    )
    dense = F.expr(f"transform(sequence(0, {CHUNK_WORDS - 1}), i -> coalesce(try_element_at(set, i), 0L))")
    packed = chunks.select(F.col("chunk").cast("int").alias("chunk"), dense.alias("words"))
    found = packed.agg(F.map_from_entries(F.collect_list(F.struct("chunk", "words"))).alias("chunks"))
    last = bits // (WORD_BITS * CHUNK_WORDS) - 1
    return found.select(F.expr(f"transform(sequence(0, {last}), i -> try_element_at(chunks, i))").alias("bitmap"))


def rows_that_may_match(
    rows: DataFrame, keys: DataFrame, on: Sequence[str], bits: int = BITMAP_BITS
) -> DataFrame:
    """Rows whose key may be in ``keys``: all that are, and a few others (one in ``bits / number of keys``)."""
    kinds = dict(rows.dtypes)
    bitmap = key_bitmap(keys, [F.col(c).cast(kinds[c]) for c in on], bits).scalar()
    place = _place([F.col(c) for c in on], bits)
    chunk = F.floor(place / (WORD_BITS * CHUNK_WORDS)).cast("int")
    word = (F.floor(place / WORD_BITS) % CHUNK_WORDS).cast("int")
    known = F.getbit(F.get(F.get(bitmap, chunk), word), (place % WORD_BITS).cast("int"))
    return rows.where(known == 1)
