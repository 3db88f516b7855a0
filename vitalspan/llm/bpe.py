"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word of up to ``SHORT`` bytes is held as two flat lists: the token of every part and
the merge rank of every adjacent pair.  Each step scans the ranks for the minimum,
deletes that boundary and refreshes the two neighbouring ranks.  The lists are so short
that scanning beats any queue; a longer word takes a heap over linked parts, with the
same result.  Every distinct word is encoded once per worker and kept in a bounded table.

The text is cut where the tokenizer's pattern always cuts (before a space that a
non-space follows), and the pattern runs on the pieces that are new.

Defined cases: null counts as the empty text, which has no tokens; the text of a special
token becomes that token; repeated rows give repeated results; texts of any length are
encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from vitalspan.llm.common import annotate, as_bytes, free_name, per_stage, text_bytes

SHORT = 200
TABLE_ENTRIES = 400_000
TABLE_KEY = 64  # longer pieces are worked out each time, so that the bound on entries is one on bytes
NEVER = 1 << 60
LATIN_END = "\u0250"

# Fixed values of the byte-level pre-tokenizer: its pattern, and the printable bytes that
# stand for themselves in vocabulary files (all others are shifted to 256 and above).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

UNSURE = re.compile(rb" (?=[\x09-\x0d\x1c-\x20\xc2\xe1\xe2\xe3]|\Z)")
_CUT = re.compile(r" (?=[^\s])")


def byte_names() -> dict[str, int]:
    names = {chr(b): b for b in PRINTABLE}
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return names | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, names = spec["model"]["vocab"], byte_names()
        self.token_bytes = {i: bytes(names[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for name, b in names.items():
            self.byte_ids[b] = vocab[name]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: s.encode() for s, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        # Words in front of different punctuation are different pieces but the same word.
        self.known_words = Table(lambda word: array("I", self.word(word.encode())).tobytes())
        self.splitter = ByteLevel(add_prefix_space=False)
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.special_bytes = [s.encode() for s in self.special]

    def rank(self, left: int, right: int) -> int:
        found = self.merges.get((left, right))
        return found[0] if found else NEVER

    def word(self, raw: bytes) -> list[int]:
        """Tokens of one pre-token."""
        parts = [self.byte_ids[b] for b in raw]
        if len(parts) > SHORT:
            return self._long_word(parts)
        merges, get = self.merges, self.rank
        ranks = [get(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            parts[i] = merges[parts[i], parts[i + 1]][1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = get(parts[i], parts[i + 1])
        return parts

    def _long_word(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.rank(parts[i], parts[i + 1])) != NEVER]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or self.rank(parts[i], parts[j]) != rank:
                continue
            parts[i], alive[j] = self.merges[parts[i], parts[j]][1], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := self.rank(parts[a], parts[after[a]])) != NEVER:
                    heapq.heappush(heap, (r, a))
        return [p for p, here in zip(parts, alive, strict=True) if here]

    def piece(self, raw: bytes) -> list[int]:
        """Tokens of a piece without special tokens."""
        words = self.split_words(raw.decode("utf-8"))
        return memoryview(b"".join([self.known_words[word] for word in words])).cast("I").tolist()

    def split_words(self, text: str) -> list[str]:
        if max(text, default="") < LATIN_END:
            return self.pattern.findall(text)
        # Beyond Latin the two regex engines know different versions of Unicode: take the
        # character classes of the tokenizers library itself.
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def pieces(self, text: bytes) -> list[bytes]:
        """Cut a text into pieces that the pattern never crosses; special tokens stand alone."""
        if not text:
            return []
        if any(s in text for s in self.special_bytes):
            out, at, whole = [], 0, text.decode("utf-8")
            for m in self.special_pattern.finditer(whole):
                out += self._plain(whole[at : m.start()].encode())
                out.append(m.group().encode())
                at = m.end()
            return out + self._plain(whole[at:].encode())
        return self._plain(text)

    def _plain(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        if UNSURE.search(text):
            first, *rest = _CUT.split(text.decode("utf-8"))
            cut = ([first.encode()] if first else []) + [b" " + p.encode() for p in rest]
            return cut
        first, *rest = text.split(b" ")
        return ([first] if first else []) + [b" " + p for p in rest]

    def encode_piece(self, raw: bytes) -> list[int]:
        special = self.special.get(raw.decode("utf-8")) if raw in self.special_bytes else None
        return self.piece(raw) if special is None else [special]

    def encode(self, text: bytes) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class Table(dict):
    """Short piece -> value, filled on first use and emptied when it is full."""

    def __init__(self, make, entries: int = TABLE_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, piece: bytes):
        value = self.make(piece)
        if len(piece) <= TABLE_KEY:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value


_CODECS: dict[str, ByteBpe] = {}
_TABLES: dict[tuple[str, str], Table] = {}
per_stage(_CODECS)
per_stage(_TABLES)


def codec(path: str) -> ByteBpe:
    if path not in _CODECS:
        _CODECS[path] = ByteBpe(path)
    return _CODECS[path]


def table(path: str, kind: str, make) -> Table:
    if (path, kind) not in _TABLES:
        _TABLES[path, kind] = Table(make)
    return _TABLES[path, kind]


def encoded(df: DataFrame, path: str, *, text: str = "text", name: str = "ids") -> DataFrame:
    """Add the tokens of every whole text as an array of int (replaces a column of that name)."""

    def batch(texts):
        bpe = codec(path)
        known = table(path, "ids", bpe.encode_piece)
        return {"ids": [[i for p in bpe.pieces(t) for i in known[p]] for t in as_bytes(texts)]}

    step = free_name(df.columns, "_encoded")
    out = annotate(df, [text_bytes(text)], batch, "ids array<int>", step)
    return out.withColumn(name, F.col(step)["ids"]).drop(step)


def decoded(df: DataFrame, path: str, *, ids: str | Column = "ids", name: str = "text") -> DataFrame:
    """Add the text of an array of tokens (replaces a column of that name); null gives the empty text."""

    def batch(arrays):
        bpe = codec(path)
        return {"text": [bpe.decode(a or []) for a in arrays.to_pylist()]}

    step = free_name(df.columns, "_decoded")
    column = F.col(ids) if isinstance(ids, str) else ids
    out = annotate(df, [column], batch, "text string", step)
    return out.withColumn(name, F.col(step)["text"]).drop(step)


def _digest_entry(bpe: ByteBpe, odd: dict[bytes, bytes]):
    """Decimal tokens of a piece; what it decodes to goes to ``odd`` where that is not the piece."""

    def make(piece: bytes) -> bytes:
        ids = bpe.encode_piece(piece)
        back = b"".join(map(bpe.token_bytes.__getitem__, ids))
        if back != piece:
            odd[piece] = back
        return b",".join([b"%d" % i for i in ids])

    return make


def round_trip(df: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text; one row each with count and digests of tokens and decoded text."""

    def batch(texts):
        bpe = codec(path)
        odd: dict[bytes, bytes] = {}
        known = table(path, "digest", None)
        known.make = _digest_entry(bpe, odd)
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for raw in as_bytes(texts):
            pieces = bpe.pieces(raw)
            ids = b",".join(list(map(known.__getitem__, pieces)))
            out["n_tokens"].append(ids.count(b",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            back = b"".join([odd.get(p, p) for p in pieces] if odd else pieces).decode("utf-8", "replace")
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
        for piece in odd:
            known.pop(piece, None)
        return out

    step = "_digests"
    rows = df.select(F.col(doc_id), F.col(text))
    out = annotate(rows, [text_bytes(text)], batch, "n_tokens long, ids_sha256 string, decoded_sha256 string", step)
    return out.select(doc_id, f"{step}.*")
