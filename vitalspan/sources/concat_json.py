"""Data source for files of JSON objects written back to back.

``spark.read.format("concatenated_json").option("paths", json_list).load()`` gives one row per
framed item.  ``source`` is the full path (and member), so inputs of one name in different
folders stay apart.  Plain files are cut into byte ranges.  A range starts at the first ``}`` that is
followed by ``{`` with only white space between: inside valid JSON a comma has to stand there,
so this is an object boundary unless it lies in a text value.  Each range reports where its
reading really ended, so a wrong guess is found and read again (see ``plans.conversion``).
Members of zip archives are read as one stream.

Objects are cut by their structure (braces outside of text values, found by array operations
over whole chunks) and checked by Arrow's parser; the item-by-item decoder only reads what is
broken.  Rows leave the reader as Arrow record batches.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import IO, Any

import numpy as np
import pyarrow as pa
import pyarrow.json as arrow_json
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

try:  # adds the deflate64 method to zipfile where it is installed
    import zipfile_deflate64  # noqa: F401
except ImportError:
    pass

NAME = "concatenated_json"
SCHEMA = "source string, range_id int, kind string, byte_offset bigint, item int, text string"
CHUNK = 1 << 20
RANGE_BYTES = 128 << 20
BOUNDARY = re.compile(rb"\}\s*\{")
SPACE = re.compile(r"\s*")
DECODER = json.JSONDecoder()


@dataclass
class ByteRange(InputPartition):
    path: str
    member: str | None
    range_id: int
    start: int
    end: int | None
    exact_start: bool = True


def open_binary(path: str) -> tuple[IO[bytes], int]:
    """Seekable stream and size of a local path or of a URI of a shared store."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        store, inner = fs.FileSystem.from_uri(path)
    else:
        store, inner = fs.LocalFileSystem(), path
    return store.open_input_file(inner), store.get_file_info(inner).size


def stored_size(path: str) -> int:
    stream, size = open_binary(path)
    stream.close()
    return size


def pick_member(archive: zipfile.ZipFile) -> str:
    """The JSON member of an archive, the largest one when there are several."""
    members = [m for m in archive.infolist() if m.filename.lower().endswith(".json")]
    if not members:
        raise FileNotFoundError("no .json member in the archive")
    return max(members, key=lambda m: m.file_size).filename


def boundary_after(stream: IO[bytes], start: int) -> int | None:
    """Position of the first object that a boundary at or after ``start`` opens."""
    stream.seek(start)
    held = b""
    base = start
    while True:
        chunk = stream.read(CHUNK)
        held += chunk
        found = BOUNDARY.search(held)
        if found:
            return base + found.end() - 1
        if not chunk:
            return None
        keep = held.rfind(b"}")
        cut = keep if keep >= 0 else len(held)
        base, held = base + cut, held[cut:]


# --- framing by structure -----------------------------------------------------------------

OPEN, CLOSE, QUOTE, ESCAPE = b"{}\"\\"
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\r")] = True
FIRST_WINDOW = 1 << 14
_NO_FIELDS = arrow_json.ParseOptions(
    explicit_schema=pa.schema([]), newlines_in_values=True, unexpected_field_behavior="ignore"
)


def object_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the whole top-level objects, by braces outside of text values."""
    at = np.flatnonzero((data == QUOTE) | (data == OPEN) | (data == CLOSE) | (data == ESCAPE))
    kind = data[at]
    if (kind == ESCAPE).any():
        escapes = at[kind == ESCAPE]
        first = np.concatenate([[True], np.diff(escapes) != 1])
        run_start = escapes[np.maximum.accumulate(np.where(first, np.arange(len(escapes)), 0))]
        # A mark is escaped when an odd number of backslashes stands right before it.
        before = np.searchsorted(escapes, at) - 1
        near = (before >= 0) & (escapes[before] == at - 1)
        escaped = near & ((at - run_start[before]) % 2 == 1)
        plain = ~escaped & (kind != ESCAPE)
        at, kind = at[plain], kind[plain]
    quotes = kind == QUOTE
    outside = np.flatnonzero(((np.cumsum(quotes, dtype=np.int32) & 1) == 0) & ~quotes)
    at, kind = at[outside], kind[outside]
    depth = np.cumsum(np.where(kind == OPEN, np.int32(1), np.int32(-1)), dtype=np.int32)
    ends = np.flatnonzero((kind == CLOSE) & (depth == 0))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    return at[starts], at[ends] + 1


def _well_formed(data: bytes, array: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bool:
    """Whether the spans are valid objects with nothing but white space before and between them."""
    gaps = np.concatenate([starts[:1], starts[1:] - ends[:-1]])
    if (gaps < 0).any():
        return False
    widest = int(gaps.max())
    lows = np.concatenate([[0], ends[:-1]])
    for k in range(min(widest, 2)):
        if not _BLANK[array[lows[gaps > k] + k]].all():
            return False
    if widest > 2 and any(data[low : low + gap].strip(b" \t\n\r") for low, gap in zip(lows[gaps > 2], gaps[gaps > 2], strict=True)):
        return False
    body = data[int(starts[0]) : int(ends[-1])]
    if b"NaN" in body or b"Inf" in body:
        return False  # the two parsers know different words for these
    try:
        read = arrow_json.ReadOptions(use_threads=False, block_size=len(body) + 1)
        return arrow_json.read_json(pa.BufferReader(body), read_options=read, parse_options=_NO_FIELDS).num_rows == len(starts)
    except pa.ArrowInvalid:
        return False


def _texts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as texts, without a Python object for each."""
    low, high = int(starts[0]), int(ends[-1])
    try:
        data[low:high].decode("utf-8")
    except UnicodeDecodeError:
        return pa.array([_clean(data[a:b].decode("utf-8", "surrogateescape")) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    # Spans and the gaps between them alternate; every second one is an object.
    borders = np.stack([starts, ends], axis=1).ravel().astype(np.int64) - low
    pieces = pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), pa.py_buffer(data[low:high]))
    return pieces.take(pa.array(np.arange(0, len(borders) - 1, 2))).cast(pa.string())


def _clean(text: str) -> str:
    """Text without the stand-ins of bytes that are not UTF-8."""
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


# --- framing item by item -----------------------------------------------------------------


@dataclass
class Reading:
    """What is held of a stream, where it starts, and how many objects came before."""

    stream: IO[bytes]
    here: int
    stop: int | None
    held: bytes = b""
    finished: bool = False
    count: int = 0

    def more(self) -> None:
        # Twice what is held, so that an object larger than a chunk is not scanned over and over.
        chunk = self.stream.read(max(CHUNK, len(self.held)))
        self.finished = not chunk
        self.held += chunk

    def drop(self, n: int) -> None:
        self.held, self.here = self.held[n:], self.here + n

    def reached(self) -> bool:
        return self.stop is not None and self.here >= self.stop


Item = tuple[str, int, int, str | None]


def _careful(state: Reading, until: int) -> list[Item]:
    """Items up to the first one that starts at ``until`` or later, one by one with the decoder's messages.

    After an unreadable item reading goes on at the next ``{``.  Stops early where more bytes are needed.
    """
    text, out = state.held.decode("utf-8", "surrogateescape"), []

    def size(low: int, high: int) -> int:
        return high - low if text.isascii() else len(text[low:high].encode("utf-8", "surrogateescape"))

    at, here = 0, state.here
    while True:
        blank = SPACE.match(text, at).end()
        here += size(at, blank)
        at = blank
        if at >= len(text) or here >= until or (state.stop is not None and here >= state.stop):
            break
        try:
            value, after = DECODER.raw_decode(text, at)
        except json.JSONDecodeError as error:
            resume = text.find("{", max(error.pos, at + 1))
            cut_short = error.msg.startswith("Unterminated string") and not state.finished
            if resume < 0 or cut_short:
                break
            out.append(("parse", here + size(at, error.pos), state.count, error.msg))
            here += size(at, resume)
            at = resume
            continue
        if after == len(text) and not state.finished and not isinstance(value, dict):
            break  # a number or word may go on in the next chunk
        if isinstance(value, dict):
            state.count += 1
            out.append(("object", here, state.count, _clean(text[at:after])))
        else:
            out.append(("other", here, state.count, type(value).__name__))
        here += size(at, after)
        at = after
    state.drop(here - state.here)
    return out


def framed(stream: IO[bytes], position: int, stop: int | None) -> Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]:
    """Arrays kind, byte offset, running number, text of the items from ``position`` until the first at or after ``stop``.

    ``object`` items carry their text, ``parse`` the decoder's message, ``other`` stands for values
    that are not objects, and the last row ``end`` gives the position reached.  Windows of well-formed
    objects are cut by their structure; only where that fails the items are decoded one by one, over
    a small window that grows again.
    """
    state, window = Reading(stream, position, stop), CHUNK
    while True:
        starved = True
        while state.held and not state.reached():
            data = state.held[:window]
            array = np.frombuffer(data, np.uint8)
            starts, ends = object_spans(array)
            if stop is not None:
                inside = int(np.searchsorted(starts, stop - state.here))
                starts, ends = starts[:inside], ends[:inside]
            if len(starts) and _well_formed(data, array, starts, ends):
                numbers = np.arange(state.count + 1, state.count + len(starts) + 1)
                kinds = pa.repeat(pa.scalar("object"), len(starts))
                yield kinds, pa.array(starts + state.here), pa.array(numbers), _texts(data, starts, ends)
                state.count += len(starts)
                state.drop(int(ends[-1]))
                window = min(2 * window, CHUNK)
                continue
            if not len(starts) and len(data) < len(state.held):
                window *= 2  # an object larger than the window, or a broken one
                continue
            small = min(window, FIRST_WINDOW) if len(starts) else len(data)
            before = state.here
            if found := _careful(state, state.here + small):
                yield _arrays(found)
            if state.here == before:
                starved = False
                break
            window = FIRST_WINDOW
        if state.reached() or state.finished:
            break
        if starved or not state.held or state.here >= 0:
            state.more()
    if not state.reached() and state.held.strip():
        yield _arrays([("parse", state.here, state.count, "the file ends inside an item")])
    yield _arrays([("end", state.here, state.count, None)])


def _arrays(items: list[Item]) -> tuple[pa.Array, ...]:
    kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
    return tuple(pa.array(c, kind) for c, kind in zip(zip(*items, strict=True), kinds, strict=True))


def frame(stream: IO[bytes], position: int, stop: int | None) -> Iterator[Item]:
    """The rows of ``framed`` one by one."""
    for columns in framed(stream, position, stop):
        yield from zip(*(c.to_pylist() for c in columns), strict=True)


_ARROW = pa.schema(
    [("source", pa.string()), ("range_id", pa.int32()), ("kind", pa.string()), ("byte_offset", pa.int64()), ("item", pa.int32()), ("text", pa.string())]
)


def record_batch(source: str, range_id: int, kind: pa.Array, offset: pa.Array, item: pa.Array, text: pa.Array) -> pa.RecordBatch:
    n = len(kind)
    columns = [pa.repeat(pa.scalar(source), n), pa.repeat(pa.scalar(range_id, pa.int32()), n), kind, offset, item.cast(pa.int32()), text]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class ConcatenatedJsonReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"])
        self.member = options.get("member")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.fixed = json.loads(options["ranges"]) if "ranges" in options else None

    def partitions(self) -> list[ByteRange]:
        if self.fixed is not None:
            return [ByteRange(*r) for r in self.fixed]
        out: list[ByteRange] = []
        for path in self.paths:
            suffix = PurePosixPath(path).suffix.lower()
            if suffix == ".zip":
                out.append(ByteRange(path, self.member, 0, 0, None))
            elif suffix == ".json":
                size = stored_size(path)
                starts = list(range(0, max(size, 1), self.range_bytes))
                for i, start in enumerate(starts):
                    last = i == len(starts) - 1
                    out.append(ByteRange(path, None, i, start, None if last else starts[i + 1], i == 0))
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        stream, _ = open_binary(partition.path)
        source, number = partition.path, partition.range_id
        with stream:
            if partition.path.lower().endswith(".zip"):
                with zipfile.ZipFile(stream) as archive:
                    member = partition.member or pick_member(archive)
                    with archive.open(member) as inner:
                        for columns in framed(inner, 0, None):
                            yield record_batch(f"{source}::{member}", number, *columns)
                return
            start = partition.start if partition.exact_start else boundary_after(stream, partition.start)
            yield record_batch(source, number, *_arrays([("start", -1 if start is None else start, 0, partition.path)]))
            if start is None:
                return
            stop = None if partition.end is None else boundary_after(stream, partition.end)
            if stop is not None and stop <= start:
                yield record_batch(source, number, *_arrays([("end", start, 0, None)]))
                return
            stream.seek(start)
            for columns in framed(stream, start, stop):
                yield record_batch(source, number, *columns)


class ConcatenatedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> ConcatenatedJsonReader:
        return ConcatenatedJsonReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ConcatenatedJson)
