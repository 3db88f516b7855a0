"""Helpers that the text operators share: word cutting, batch annotation, blocks, shared storage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII letters and digits and every byte of a longer UTF-8 sequence belong to words.
_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
PORTION_BYTES = 8 << 20
_LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


def spaced_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.translate(_LOWER_TABLE).split()


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER_TABLE)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a binary or string column as bytes; null becomes the empty text."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    return [v or b"" for v in column.to_pylist()]


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A column name that none of the columns has, however it is capitalised."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def annotate(df: DataFrame, inputs: Sequence[Column], fn: Callable, schema: str, name: str) -> DataFrame:
    """Add one struct column computed batch by batch.

    ``fn`` gets one Arrow array per input and returns a dict of lists, one list per
    field of ``schema``.  ``name`` must not be a column of ``df`` (see ``free_name``).
    Only the inputs travel to Python, the other columns stay in the JVM.
    """
    struct, stage = T._parse_datatype_string(schema), uuid.uuid4().hex

    def batch(*arrays: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        enter(stage)
        kind, parts = to_arrow_type(struct), []
        for low, rows in slices(arrays[0], sum(a.nbytes for a in arrays)):
            columns = fn(*[a.slice(low, rows) for a in arrays])
            fields = [pa.array(columns[f.name], f.type) for f in kind]
            parts.append(pa.StructArray.from_arrays(fields, fields=list(kind)))
        give_back()
        return pa.concat_arrays(parts)

    # The annotations tell Spark which flavour of function this is.
    batch.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return df.withColumn(name, F.arrow_udf(batch, struct)(*inputs))


def slices(rows: pa.Array | pa.RecordBatch, nbytes: int) -> list[tuple[int, int]]:
    """(start, rows) of portions of about ``PORTION_BYTES``, so that few texts are copied at a time."""
    n = len(rows) if isinstance(rows, pa.Array) else rows.num_rows
    step = max(1, n * PORTION_BYTES // max(1, nbytes))
    return [(low, min(step, n - low)) for low in range(0, max(n, 1), step)]


_CACHES: list[dict] = []
_STAGE = [""]


def per_stage(cache: dict) -> None:
    """Tables of a worker that live as long as it works for one stage (see ``enter``)."""
    _CACHES.append(cache)


def enter(stage: str) -> None:
    """Workers are reused: what they have kept for another stage goes."""
    if _STAGE[0] != stage:
        _STAGE[0] = stage
        for cache in _CACHES:
            cache.clear()
        gc.collect()


def give_back() -> None:
    """Hand freed memory to the system: workers are reused, and what every stage leaves in them adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(column: str = "text") -> Column:
    return F.col(column).cast("string").cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors and the driver share.

    Where the setting is missing (tests on one machine) a folder of the warehouse is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/text-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_count(docs: DataFrame, column: str = "text", block_bytes: int = 12 << 20) -> int:
    """Number of blocks such that one holds about ``block_bytes`` of text."""
    total = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


# --- hashing of byte strings in numpy -------------------------------------------------

_rng = np.random.default_rng(20_240_607)
_BYTE_VALUES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))


_CHUNK = 1 << 18
_POWERS = _powers(_CHUNK + 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Rolling 64-bit hash of every ``k`` consecutive bytes, by doubling."""
    if len(data) < k:
        return np.zeros(0, np.uint64)
    level, size = _BYTE_VALUES[data], 1
    out, have = None, 0
    while True:
        if k & size:
            if out is None:
                out = level
            else:
                n = min(len(out), len(level) - have)
                out = out[:n] * _POWERS[size] + level[have : have + n]
            have += size
        if size * 2 > k:
            break
        level = level[: len(level) - size] * _POWERS[size] + level[size:]
        size *= 2
    return mix(out[: len(data) - k + 1])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``data[start:end]``; equal bytes give equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Sum of byte values times powers, counted from the end of the data to the left, so
    # that the power of the span's last byte can be divided out by multiplication.
    out = np.empty(len(starts), np.uint64)
    total = len(data)
    for low in range(0, total, _CHUNK // 2):
        chosen = slice(*np.searchsorted(starts, [low, low + _CHUNK // 2]))
        s, e = starts[chosen], ends[chosen]
        if not len(s):
            continue
        top = int(e.max())
        if top - low > _CHUNK:  # a span longer than a chunk: hash it on its own
            out[chosen] = [_long_span(data[a:b]) for a, b in zip(s, e, strict=True)]
            continue
        part = _BYTE_VALUES[data[low:top]] * _POWERS[: top - low][::-1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        out[chosen] = (sums[e - low] - sums[s - low]) * _INVERSES[top - e]
    return mix(out ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long_span(data: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    for low in range(0, len(data), _CHUNK):
        part = data[low : low + _CHUNK]
        with np.errstate(over="ignore"):
            own = np.sum(_BYTE_VALUES[part] * _POWERS[: len(part)][::-1], dtype=np.uint64)
            h = h * _POWERS[len(part)] + own
    return h


_INVERSES = np.cumprod(
    np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK, pow(int(_BASE), -1, 2**64), np.uint64)])
)
