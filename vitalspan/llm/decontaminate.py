"""Benchmark decontamination: Wu-Manber search for benchmark word windows.

The alphabet is words.  Patterns of one length share a shift table over blocks of
``BLOCK`` words: a block that ends at place ``j`` of some pattern allows a jump of at
most ``length - j``, an unknown block jumps over a whole pattern.  Where the jump is 0,
the patterns with that last block are compared word by word.  Most of a text is never
compared, and no table depends on the text.

Benchmark items are taken in blocks of bounded size (``PATTERN_BYTES``); each block is
one broadcast and one more pass over the rows in the same stage, so the documents are
never shuffled, whatever the size of the benchmark.

Defined cases: a null or empty text has no words and is never contaminated; null or
wordless items match nothing; items with equal windows all count; repeated rows are
judged row by row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import alnum_words, annotate, as_bytes, free_name, text_bytes

WINDOW = 13
BLOCK = 3
PATTERN_BYTES = 8 << 20


class WuManber:
    """Searches word sequences for all given windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = block = min(BLOCK, length)
        self.far = length - block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list] = defaultdict(list)
        for window, items in windows.items():
            for end in range(block, length + 1):
                key = window[end - block : end]
                jump = length - end
                if jump < self.shift.get(key, self.far):
                    self.shift[key] = jump
            self.buckets[window[length - block :]].append((list(window), items))

    def find(self, words: list[bytes]) -> Iterable[tuple[int, set[str]]]:
        """Start of every occurrence, with the items that have the window."""
        length, block, far, shift, n = self.length, self.block, self.far, self.shift.get, len(words)
        at = length
        while at <= n:
            key = tuple(words[at - block : at])
            jump = shift(key, far)
            if jump:
                at += jump
                continue
            here = words[at - length : at]
            for window, items in self.buckets[key]:
                if window == here:
                    yield at - length, items
            at += 1


class Matcher:
    """All windows of a set of items, grouped by window length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            words = alnum_words(text)
            length = min(window, len(words))
            for i in range(len(words) - length + 1 if length else 0):
                by_length[length][tuple(words[i : i + length])].add(item)
        self.searches = [WuManber(n, w) for n, w in sorted(by_length.items())]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (may overlap) and the items with occurring windows."""
        ranges, items = [], set()
        for search in self.searches:
            for start, found in search.find(words):
                ranges.append((start, start + search.length))
                items |= found
        return ranges, items


def merged(ranges: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _search(matcher: Matcher):
    def batch(text, before):
        columns = {"n_words": [], "ranges": [], "items": []}
        for raw, had in zip(as_bytes(text), before.to_pylist(), strict=True):
            words = alnum_words(raw)
            ranges, items = matcher.find(words)
            if had:
                ranges += [tuple(r) for r in had["ranges"]]
                items |= set(had["items"])
            columns["n_words"].append(len(words))
            columns["ranges"].append(merged(ranges))
            columns["items"].append(sorted(items))
        return columns

    return batch


_FOUND = "n_words long, ranges array<array<int>>, items array<string>"
_MATCHERS: dict[str, Matcher] = {}


def _blocks(benchmark: DataFrame, item_id: str, text: str, pattern_bytes: int) -> Iterable[list]:
    """The items, block by block, each of bounded size (or one single larger item)."""
    items = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("string").alias("item"), text_bytes(text).alias("body")
    )
    total = items.agg(F.sum(F.length("body"))).first()[0] or 0
    count = max(1, -(-total // pattern_bytes))
    part = F.pmod(F.xxhash64("item", "body"), F.lit(count))
    for i in range(count):
        yield [(r.item, bytes(r.body)) for r in items.where(part == i).distinct().collect()]


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pattern_bytes: int = PATTERN_BYTES,
) -> DataFrame:
    """Add the struct ``name`` (n_words, merged hit word ranges, sorted items) to every row."""
    context = docs.sparkSession.sparkContext
    out = docs.withColumn(name, F.lit(None).cast(f"struct<{_struct(_FOUND)}>"))
    for items in _blocks(benchmark, item_id, item_text, pattern_bytes):
        step = free_name(out.columns, "_step")
        out = annotate(out, [text_bytes(text), F.col(name)], _pass(context.broadcast(items), window), _FOUND, step)
        out = out.withColumn(name, F.col(step)).drop(step)
    return out


def _pass(items: Broadcast, window: int):
    key = uuid.uuid4().hex

    def batch(texts, before):
        # One table per worker and block; a worker that meets another block builds that one.
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(items.value, window)
        return _search(_MATCHERS[key])(texts, before)

    return batch


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.strip().split(" ", 1) for part in ddl.split(", ")))


def judged(found: str, percent: int = 5) -> dict[str, Column]:
    """Columns of the verdict: contaminated when hit words are at least ``percent`` of all words."""
    f = F.col(found)
    hits = F.aggregate(f["ranges"], F.lit(0).cast("long"), lambda a, r: a + (r[1] - r[0]))
    return {
        "n_words": f["n_words"],
        "n_hit": hits,
        "n_items": F.size(f["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(f["items"], ",").cast("binary"), 256),
        "contaminated": (hits > 0) & (hits * 100 >= f["n_words"] * percent),
    }


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document with its counts and verdict."""
    found = find_windows(docs.select(doc_id, options.get("text", "text")), benchmark, "_windows", **options)
    return found.select(doc_id, *(c.alias(n) for n, c in judged("_windows").items()))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    name = free_name(docs.columns, "_windows")
    found = find_windows(docs, benchmark, name, **options)
    return found.where(~judged(name)["contaminated"]).select(*(F.col(f"`{c}`") for c in docs.columns))
