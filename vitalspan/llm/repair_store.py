"""Token files compressed by a Re-Pair grammar, with random access.

Texts are encoded with the tokenizers library and written in ascending doc_id order as
shards of about ``SHARD`` tokens.  Inside a shard, frequent pairs of neighbouring symbols
are replaced by new symbols again and again; a round takes the most frequent pairs
together, reading from left to right, and rounds go on until no pair is frequent.  A shard
stores its rules, the expanded length of every rule and of every ``STRIDE`` symbols, so
``token_range`` decodes any stretch of tokens without expanding the rest.

Shards are rows of Parquet files, written and committed by Spark.  The documents are dealt
by ranges of doc_id; where a document starts follows from sums per shard and per range.

Defined cases: null is the empty text (only the end id); rows without doc_id come first;
repeated doc_ids stay neighbours; a document is never cut, a longer one makes a larger
shard; an empty table writes no shard and reads back as no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitalspan.llm.bpe import UNSURE, byte_names, codec
from vitalspan.llm.common import as_bytes, block_count, shared_folder, span_hashes, text_bytes

SHARD = 1 << 20
STRIDE = 1024
END_ID = 2
LEAST_COUNT = 8
MOST_PAIRS = 4096
LEAST_GAIN = 0.02
SLOT_BITS = 18
BYTES_AT_ONCE = 4 << 20
WORDS_KEPT = 1 << 21
TOKENS_KEPT = 1 << 24
RANGE_BYTES = 24 << 20

SCHEMA = (
    "part int, seq int, total long, doc_ids array<long>, ends binary, base long, "
    "rules binary, lengths binary, low binary, high binary, marks binary"
)


# --- grammar ---------------------------------------------------------------------------


def _chosen(first: np.ndarray) -> np.ndarray:
    """Of candidate places (sorted), those taken from left to right without overlap."""
    fresh = np.concatenate([[True], np.diff(first) > 1])
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(first)), 0))
    return first[(np.arange(len(first)) - start) % 2 == 0]


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule ``i`` rewrites the symbol ``base + i`` into two earlier symbols."""
    symbols, rules = ids.astype(np.uint64), [np.zeros((0, 2), np.uint64)]
    made = 0
    while len(symbols) > 1:
        key = symbols[:-1] << np.uint64(32) | symbols[1:]
        ordered = np.sort(key)
        cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        count, pairs = np.diff(cuts), ordered[cuts[:-1]]
        often = np.flatnonzero(count >= LEAST_COUNT)
        if not len(often):
            break
        # The most frequent pairs; ties by value, so that a rerun writes the same file.
        often = often[np.lexsort((pairs[often], -count[often]))][:MOST_PAIRS]
        # A table by hash finds the pair of every place; of two pairs in one slot the more
        # frequent is taken now, the other in a later round.
        pairs = pairs[often]
        table = np.full(1 << SLOT_BITS, -1, np.int32)
        table[_slot(pairs)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
        at = table[_slot(key)]
        places = _chosen(np.flatnonzero((at >= 0) & (pairs[at] == key)))
        taken = np.bincount(at[places], minlength=len(pairs)) > 0
        used, new = np.flatnonzero(taken), (np.cumsum(taken) - 1).astype(np.uint64)
        symbols[places] = np.uint64(base + made) + new[at[places]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        before = len(symbols)
        symbols = symbols[keep]
        rules.append(np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], 1))
        made += len(used)
        if before - len(symbols) < LEAST_GAIN * before:
            break
    return symbols.astype(np.uint32), np.concatenate(rules).astype(np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Number of tokens that each rule stands for."""
    out = np.ones(len(rules), np.int64)
    level = np.zeros(len(rules), bool)
    while not level.all():
        children = rules.astype(np.int64) - base
        ready = ((children < 0) | level[np.maximum(children, 0)]).all(axis=1) & ~level
        out[ready] = np.where(children < 0, 1, out[np.maximum(children, 0)])[ready].sum(axis=1)
        level |= ready
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens that the symbols stand for; every rule among them is expanded once."""
    symbols = symbols.astype(np.int64)
    compound = np.flatnonzero(symbols >= base)
    if not len(compound):
        return symbols.astype(np.uint32)
    number = symbols[compound] - base
    used = np.flatnonzero(np.bincount(number, minlength=len(rules)))
    flat, owner = used + base, used
    while (deep := flat >= base).any():
        size = 1 + deep
        out, owner = np.repeat(flat, size), np.repeat(owner, size)
        at = (np.cumsum(size) - size)[deep]
        pair = rules[flat[deep] - base]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        flat = out
    length = np.bincount(owner, minlength=len(rules))
    # Symbols follow the expanded rules, so that one step takes both from one array.
    size, low = np.ones(len(symbols), np.int64), np.arange(len(symbols)) + len(flat)
    size[compound], low[compound] = length[number], (np.cumsum(length) - length)[number]
    done = np.cumsum(size)
    tokens = np.concatenate([flat, symbols]).astype(np.uint32)
    return tokens[np.repeat(low - (done - size), size) + np.arange(done[-1])]


def _symbols(shard: dict, low: int = 0, high: int | None = None) -> np.ndarray:
    a = np.frombuffer(shard["low"], "<u2")[low:high].astype(np.uint32)
    return a | np.frombuffer(shard["high"], np.uint8)[low:high].astype(np.uint32) << np.uint32(16)


def _rules(shard: dict) -> np.ndarray:
    return np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)


def token_range(shard: dict, first: int, last: int) -> np.ndarray:
    """Tokens ``first`` to ``last`` (exclusive) of a shard, expanding only the symbols that hold them."""
    marks = np.frombuffer(shard["marks"], "<i8")  # tokens before every STRIDE-th symbol
    low = max(0, int(np.searchsorted(marks, first, "right")) - 1)
    high = int(np.searchsorted(marks, last, "left"))
    symbols = _symbols(shard, low * STRIDE, high * STRIDE)
    lengths = np.frombuffer(shard["lengths"], "<i8")
    base = shard["base"]
    own = np.ones(len(symbols), np.int64)
    compound = symbols >= base
    own[compound] = lengths[symbols[compound] - base]
    ends = (marks[low] if len(marks) else 0) + np.cumsum(own)
    a = int(np.searchsorted(ends, first, "right"))
    b = int(np.searchsorted(ends, last, "left")) + 1
    tokens = expand(symbols[a:b], _rules(shard), base)
    skip = first - (int(ends[a] - own[a]) if a < len(ends) else first)
    return tokens[skip : skip + last - first]


def shard_row(part: int, seq: int, doc_ids: list, sizes: list[int], ids: np.ndarray) -> dict:
    base = max(1 << 16, int(ids.max()) + 1)
    symbols, rules = compress(ids, base)
    lengths = rule_lengths(rules, base)
    own = np.ones(len(symbols), np.int64)
    own[symbols >= base] = lengths[symbols[symbols >= base] - base]
    marks = (np.cumsum(own) - own)[::STRIDE]
    if len(symbols) and int(symbols.max()) >> 24:
        raise ValueError("a shard has more symbols than its format can number")
    return {
        "part": part,
        "seq": seq,
        "total": len(ids),
        "doc_ids": doc_ids,
        "ends": np.cumsum(sizes).astype("<i8").tobytes(),
        "base": base,
        "rules": rules.astype("<u4").tobytes(),
        "lengths": lengths.astype("<i8").tobytes(),
        "low": symbols.astype("<u2").tobytes(),
        "high": (symbols >> np.uint32(16)).astype(np.uint8).tobytes(),
        "marks": marks.astype("<i8").tobytes(),
    }


# --- encoding --------------------------------------------------------------------------


class Encoder:
    """Tokens of whole texts by the tokenizers library.

    The tokenizer's pattern is applied to many texts together by array operations: a word
    begins at a space, or where the kind of character changes.  Pieces between spaces with bytes
    for which this is not enough (quotes, control characters, beyond Latin) stay whole and
    are cut by the pattern itself when they are new; texts with doubled or odd white space,
    special tokens or NUL are cut into pieces one by one.  The words are hashed (64 bits) and
    numbered, each that is new goes once through the library's model, and the tokens are laid
    out by array operations.
    """

    def __init__(self, path: str):
        # Spark already runs one task per core; a thread pool in each would only wait.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cutter = codec(path)
        self.plain = self.cutter.special_bytes
        self.names = {b: name for name, b in byte_names().items()}
        self.table = _Table()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit tokens of each text."""
        odd = [b"\0" in t or bool(UNSURE.search(t)) or any(s in t for s in self.plain) for t in texts]
        even = iter(self._even([t for t, o in zip(texts, odd, strict=True) if not o]))
        rest = iter(self._odd([t for t, o in zip(texts, odd, strict=True) if o]))
        return [next(rest if o else even) for o in odd]

    def _even(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        raw = b"\0" + b"\0".join(texts)  # NUL stands before a text
        data = np.frombuffer(raw, np.uint8)
        starts, strange = _words(data)
        ends = np.append(starts[1:], len(data))
        head = data[starts] == 0
        size, tokens = self._laid(raw, data, starts, ends, strange, head)
        done = np.cumsum(size)
        cuts = [*(done - size)[head].tolist(), int(done[-1])]
        return [tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _odd(self, texts: list[bytes]) -> list[bytes]:
        pieces = [self.cutter.pieces(t) for t in texts]
        flat = [p for own in pieces for p in own]
        if not flat:
            return [b""] * len(texts)
        raw = b"".join(flat)
        ends = np.cumsum([len(p) for p in flat])
        starts = np.concatenate([[0], ends[:-1]])
        every = np.ones(len(flat), bool)
        size, tokens = self._laid(raw, np.frombuffer(raw, np.uint8), starts, ends, every, ~every)
        cuts = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, pieces)])].tolist()
        return [tokens[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _laid(self, raw, data, starts, ends, strange, empty) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each span, all tokens); those marked ``empty`` have none."""
        kinds, first, number = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = self.table.unknown(kinds)
        at = first[new]
        self.table.add(kinds[new], self._learned(raw, starts[at].tolist(), ends[at].tolist(), strange[at].tolist()))
        low, size = self.table.find(kinds)
        size = np.where(empty, 0, size[number])
        done = np.cumsum(size)
        return size, self.table.tokens[np.repeat(low[number] - (done - size), size) + np.arange(done[-1])]

    def _learned(self, raw: bytes, starts: list, ends: list, strange: list) -> list[list[int]]:
        """Tokens of new spans."""
        tokenize, spell = self.model.tokenize, self._spelled
        text = raw.decode("latin-1") if starts else ""
        # In the vocabulary every byte is one character; of the ASCII bytes in plain words only
        # these do not stand for themselves.
        for byte in b" \n\0":
            text = text.replace(chr(byte), self.names[byte])
        return [
            self._piece(raw[a:b]) if odd
            else [t.id for t in tokenize(text[a:b] if raw[a:b].isascii() else spell(raw[a:b]))]
            for a, b, odd in zip(starts, ends, strange, strict=True)
        ]

    def _spelled(self, word: bytes) -> str:
        return word.decode("latin-1").translate(self.names)

    def _piece(self, piece: bytes) -> list[int]:
        """Tokens of a piece, word by word; special tokens are pieces of their own."""
        if piece in self.plain:
            return [self.cutter.special[piece.decode("utf-8")]]
        words = self.cutter.split_words(piece.decode("utf-8"))
        return [t.id for w in words for t in self.model.tokenize(self._spelled(w.encode("utf-8")))]


_LETTER, _DIGIT, _OTHER, _LINE, _SPACE, _NUL = range(6)
_KIND = np.array(
    [
        _NUL if b == 0 else _LINE if b == 10 else _SPACE if b == 32 else _DIGIT if 48 <= b <= 57
        else _LETTER if 65 <= b <= 90 or 97 <= b <= 122 else _OTHER
        for b in range(256)
    ],
    np.uint8,
)
_STRANGE = np.array([b >= 127 or b == 39 or (b < 32 and b not in (0, 10)) for b in range(256)])


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words, and which are whole pieces that the pattern has to cut.

    NUL is a word; a space belongs to the word behind it, and never stands before white space or NUL.
    """
    kind, odd = _KIND[data], _STRANGE[data]
    for at in _latin_letters(data):
        kind[at], odd[at] = _LETTER, False
    head = kind >= _SPACE
    head[1:] |= kind[:-1] == _NUL
    cut = head.copy()
    cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
    odd[1:] |= (kind[1:] == _LINE) & (kind[:-1] == _LINE)
    starts, odd = np.flatnonzero(cut), np.flatnonzero(odd)
    first = head[starts]
    if not len(odd):
        return starts, np.zeros(len(starts), bool)
    pieces = starts[first]
    whole = np.zeros(len(pieces), bool)
    whole[np.searchsorted(pieces, odd, "right") - 1] = True
    whole = whole[np.cumsum(first) - 1]
    keep = first | ~whole
    return starts[keep], whole[keep]


def _latin_letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second bytes of the letters U+00C0 to U+024F, which are all but two of these characters."""
    low = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    low = low[low + 1 < len(data)]
    first, second = data[low], data[low + 1]
    letter = (second >= 0x80) & (second <= np.where(first == 0xC9, 0x8F, 0xBF))
    letter &= (first != 0xC3) | ((second != 0x97) & (second != 0xB7))
    return low[letter], low[letter] + 1


class _Table:
    """Tokens by hash, in sorted arrays; when there are too many, those met lately are kept."""

    def __init__(self):
        self.clock = 0
        self._clear()

    def _clear(self):
        self.keys, self.low = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.met = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.tokens = np.zeros(0, "<u4")

    def unknown(self, kinds: np.ndarray) -> np.ndarray:
        """Numbers of the kinds (sorted) that are not in the table."""
        if len(self.keys) > WORDS_KEPT or len(self.tokens) > TOKENS_KEPT:
            self._forget()
        self.clock += 1
        at, there = self._places(kinds)
        self.met[at[there]] = self.clock
        return np.flatnonzero(~there)

    def _places(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, kinds)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == kinds[there]
        return at, there

    def add(self, kinds: np.ndarray, found: list[list[int]]):
        if not found:
            return
        size = np.fromiter(map(len, found), np.int32, len(found))
        new = np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))
        low = len(self.tokens) + np.cumsum(size, dtype=np.int64) - size
        self.tokens = np.concatenate([self.tokens, new])
        at = np.searchsorted(self.keys, kinds)
        self.keys, self.low = np.insert(self.keys, at, kinds), np.insert(self.low, at, low)
        self.size, self.met = np.insert(self.size, at, size), np.insert(self.met, at, self.clock)

    def find(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, kinds)
        return self.low[at], self.size[at]

    def _forget(self):
        # Less than half stays, also where all were met at once.
        kept = np.flatnonzero(self.met > np.median(self.met))
        size = self.size[kept].astype(np.int64)
        done = np.cumsum(size)
        if not len(kept) or done[-1] > TOKENS_KEPT // 2:
            self._clear()
            return
        self.tokens = self.tokens[np.repeat(self.low[kept] - (done - size), size) + np.arange(done[-1])]
        self.keys, self.low, self.size, self.met = self.keys[kept], done - size, self.size[kept], self.met[kept]


_ENCODERS: dict[str, Encoder] = {}


def _write_shards(path: str, end_id: int, shard: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        end, part, seq = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        ids: list = []
        bodies: list[bytes] = []
        size = 0
        for batch in batches:
            found, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for few in _portions(texts):
                for doc, body in zip(found[few], _ENCODERS[path].encode(texts[few]), strict=True):
                    ids.append(doc)
                    bodies.append(body + end)
                    size += len(bodies[-1])
                    if size >= 4 * shard:
                        yield _batch(part, seq, ids, bodies)
                        ids, bodies, size, seq = [], [], 0, seq + 1
        if ids:
            yield _batch(part, seq, ids, bodies)

    return write


def _portions(texts: list[bytes]) -> Iterator[slice]:
    """Texts of about ``BYTES_AT_ONCE``, or one longer one."""
    low, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= BYTES_AT_ONCE:
            yield slice(low, i + 1)
            low, size = i + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


def _batch(part: int, seq: int, ids: list, bodies: list[bytes]) -> pa.RecordBatch:
    row = shard_row(part, seq, ids, [len(b) // 4 for b in bodies], np.frombuffer(b"".join(bodies), "<u4"))
    kinds = {"part": pa.int32(), "seq": pa.int32(), "total": pa.int64(), "base": pa.int64(), "doc_ids": pa.list_(pa.int64())}
    names = [n.split()[0] for n in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds.get(n, pa.binary())) for n in names], names)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    shard: int = SHARD,
) -> None:
    """Write the tokens of all documents, in ascending doc_id order, to token files in ``folder``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), text_bytes(text).alias("body"))
    ranges = block_count(rows, "body", RANGE_BYTES)
    dealt = rows.repartitionByRange(ranges, "id").sortWithinPartitions("id", F.xxhash64("body"))
    dealt.mapInArrow(_write_shards(tokenizer, end_id, shard), SCHEMA).write.option("compression", "zstd").mode(
        "overwrite"
    ).parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def with_starts(shards: DataFrame) -> DataFrame:
    """Add ``before``: the tokens of all earlier shards.  Sums per range first, then inside ranges."""
    light = shards.select("part", "seq", "total")
    parts = light.groupBy("part").agg(F.sum("total").alias("sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("_parts"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    light = light.select("part", "seq", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("_shards"))
    starts = light.join(parts, "part").select("part", "seq", (F.col("_parts") + F.col("_shards")).alias("before"))
    return shards.join(starts, ["part", "seq"])


def document_digests(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the token files."""
    local = "doc_ids array<long>, starts array<long>, sizes array<long>, sums array<long>"

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = expand(_symbols(row), _rules(row), row["base"]).astype("<u4")
                ends = np.frombuffer(row["ends"], "<i8")
                starts = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(tokens[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]], pa.int32()),
                        "seq": pa.array([row["seq"]], pa.int32()),
                        "total": pa.array([row["total"]], pa.int64()),
                        "doc_ids": pa.array([row["doc_ids"]], pa.list_(pa.int64())),
                        "starts": pa.array([starts.tolist()], pa.list_(pa.int64())),
                        "sizes": pa.array([(ends - starts).tolist()], pa.list_(pa.int64())),
                        "sums": pa.array([sums], pa.list_(pa.int64())),
                    }
                )

    digests = shards.mapInArrow(read, f"part int, seq int, total long, {local}")
    light = with_starts(shards.select("part", "seq", "total")).select("part", "seq", "before")
    rows = digests.join(light, ["part", "seq"]).select(
        "before", F.explode(F.arrays_zip("doc_ids", "starts", "sizes", "sums")).alias("d")
    )
    return rows.select(
        F.col("d.doc_ids").alias(doc_id),
        (F.col("before") + F.col("d.starts")).alias("start"),
        F.col("d.sizes").alias("n_tokens"),
        F.col("d.sums").alias("ids_crc32"),
    )


def store_and_digest(docs: DataFrame, tokenizer: str, *, folder: str | None = None, **options) -> DataFrame:
    """Write the token files (to a fresh shared folder by default) and read them back."""
    folder = folder or shared_folder(docs.sparkSession)
    write_tokens(docs, folder, tokenizer, **options)
    return document_digests(read_shards(docs.sparkSession, folder), options.get("doc_id", "doc_id"))
