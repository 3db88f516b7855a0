"""Near duplicates by an exact n-gram Jaccard join on prefix trees, and their components.

A document's set is its distinct 4-word shingles.  Equal sets are one class; classes link
when ``100 * intersection >= 85 * union``.  Links are found by a tree that stores the
sets of a group in one global token order: sets with equal beginnings share a path, and a
query walks the tree carrying its overlap, leaving a subtree as soon as the remaining
lengths cannot reach the needed overlap (or all its sets are in the query's component
already).  Which sets meet in a tree is decided in three steps:

1. *Survivors.*  A class keeps at most ``d = n - ceil(0.85 n)`` shingles that a partner
   lacks.  Shingles below a fixed hash bound (all of them for small sets) are dealt by hash
   and those of a single class are found; a class with more than ``d`` of them cannot have
   a partner and is done.  Only counts travel back.
2. *Collapse.*  Survivors with equal minimum hashes meet in a tree.  Every link is verified
   on the whole sets.  Large groups are cut by a second minimum hash, and what still exceeds
   the bounds in sets or bytes by a hash of the id, so a family of any size is dealt out;
   each of these parts also has the smallest id of all, which links them.
3. *Rest.*  What the collapse may have missed lies between different components.  A
   survivor stays only if enough of its shingles occur in two components; a link needs a
   common shingle among the first ``d + 1`` of both in order of rarity (prefix filter), so
   sets that meet there meet in one more tree, which loses no link.

Components are contracted by alternating star steps on written tables.  Shingles are
64-bit hashes; nothing is dropped, capped or sampled.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and
are their own component; texts under four words are one shingle; repeated rows share a
component; rows without doc_id get component null.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import (
    annotate,
    as_bytes,
    block_count,
    enter,
    free_name,
    give_back,
    lower_ascii,
    mix,
    slices,
    span_hashes,
    text_bytes,
    written,
)

GRAM = 4
PERCENT = 85
SAMPLE_BOUND = np.uint64(int(0.3 * 2**64))  # shingles below it stand for the set when survivors are sought
SMALL_SET = 128  # sets up to this size are represented by all their shingles
ROUNDS = 2
TREE_SETS = 1024  # sets of one collapse group before it is cut into chunks
TREE_BYTES = 16 << 20  # and their bytes of text
REST_SETS = 1500
DEALT_TOKENS = 1 << 20  # shingles that a task holds before it deals them
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = np.uint64(0xA24BAED4963EE407)


# --- sets ------------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], gram: int = GRAM) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        yield from _piece_sets(texts[at:end], gram)
        at = end


def _piece_sets(texts: list[bytes], gram: int) -> Iterator[np.ndarray]:
    data = np.frombuffer(lower_ascii(b" ".join([b"", *texts, b""])), np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = np.cumsum([1] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, bounds)
    words = span_hashes(data, starts, ends)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        n = high - low
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        width = min(gram, n)
        h = words[low : high - width + 1].copy()
        for k in range(1, width):
            h = mix(h * _MULTIPLIER + words[low + k : high - width + 1 + k])
        yield np.unique(mix(h + np.uint64(width)))


def allowed_misses(n: int, percent: int = PERCENT) -> int:
    """Most shingles of a set of ``n`` that a linked set may lack."""
    return n - -(-n * percent // 100)


def stand_ins(tokens: np.ndarray, percent: int, everywhere: bool) -> np.ndarray:
    """The shingles that represent a set: what it shows others, or what it is tested by.

    A set shows all its shingles up to ``SMALL_SET``; it is tested by all of them only if
    every set that could be linked with it shows all as well.
    """
    limit = SMALL_SET if everywhere else SMALL_SET * percent // 100
    return tokens if len(tokens) <= limit else tokens[tokens < SAMPLE_BOUND]


# --- the tree --------------------------------------------------------------------------


class _Node:
    __slots__ = ("label", "children", "ends", "low", "high", "any", "uniform")

    def __init__(self, label: np.ndarray, size: int, one: int):
        self.label, self.children, self.ends = label, {}, []
        self.low = self.high = size
        self.any, self.uniform = one, True


class PrefixTree:
    """Sets in one token order, searched for linked sets in other components."""

    def __init__(self, sets: list[np.ndarray], ids: list[int], parts: list[int] | None, percent: int):
        flat = np.concatenate(sets)
        _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
        # Common tokens first: similar sets share long beginnings.
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        ranks, cuts = rank[place], np.cumsum([0] + [len(s) for s in sets])
        self.sets = [np.sort(ranks[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.ids, self.percent = ids, percent
        self.mask = np.zeros(len(count), bool)
        self.parent = list(range(len(sets)))
        self.root = _Node(np.zeros(0, np.int64), 0, -1)
        if parts is not None:
            first: dict[int, int] = {}
            for i, part in enumerate(parts):
                self.parent[i] = first.setdefault(part, i)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def links(self) -> Iterator[tuple[int, int]]:
        for i in sorted(range(len(self.sets)), key=lambda i: (len(self.sets[i]), self.ids[i])):
            yield from self._search(i)
            self._insert(i)

    def _search(self, i: int) -> Iterator[tuple[int, int]]:
        own, mask, percent = self.sets[i], self.mask, self.percent
        nx, order = len(own), own.tolist()
        mask[own] = True
        stack = [(child, 0, 0) for child in self.root.children.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if node.uniform and self.find(node.any) == self.find(i):
                continue
            label = node.label
            overlap += int(np.count_nonzero(mask[label]))
            depth += len(label)
            rest = min(node.high - depth, nx - bisect_right(order, int(label[-1])))
            if (overlap + rest) * (100 + percent) < percent * (nx + node.low):
                continue
            for j in node.ends:
                if overlap * (100 + percent) >= percent * (nx + depth):
                    a, b = self.find(i), self.find(j)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        yield self.ids[i], self.ids[j]
            stack += [(child, overlap, depth) for child in node.children.values()]
        mask[own] = False

    def _insert(self, i: int) -> None:
        rest, size, node = self.sets[i], len(self.sets[i]), self.root
        while True:
            if node is not self.root:
                node.low, node.high = min(node.low, size), max(node.high, size)
                node.uniform = node.uniform and self.find(node.any) == self.find(i)
            if not len(rest):
                node.ends.append(i)
                return
            head = int(rest[0])
            child = node.children.get(head)
            if child is None:
                node.children[head] = child = _Node(rest, size, i)
                child.ends.append(i)
                return
            n = min(len(rest), len(child.label))
            differ = np.flatnonzero(child.label[:n] != rest[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.label):
                upper = _Node(child.label[:same], child.low, child.any)
                upper.high, upper.uniform = child.high, child.uniform
                child.label = child.label[same:]
                upper.children[int(child.label[0])] = child
                node.children[head] = child = upper
            rest, node = rest[same:], child


# --- steps on Spark --------------------------------------------------------------------


def described(docs: DataFrame, doc_id: str, text: str, gram: int, percent: int) -> DataFrame:
    """id, n (set size), tested (shingles it is tested by), klass (digest of the set), key (its start)."""

    def batch(texts):
        out = {"n": [], "tested": [], "klass": [], "key": []}
        for tokens in shingle_sets(as_bytes(texts), gram):
            out["n"].append(len(tokens))
            out["tested"].append(len(stand_ins(tokens, percent, False)))
            klass = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None
            out["klass"].append(klass)
            out["key"].append(klass and _short_key(klass))
        return out

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    out = annotate(rows, [text_bytes("body")], batch, "n long, tested long, klass binary, key long", "_set")
    return out.select("id", "_set.*")


def _short_key(klass: bytes) -> int:
    return int.from_bytes(klass[:8], "little", signed=True)


def shared_counts(docs: DataFrame, text: str, gram: int, percent: int, buckets: int) -> DataFrame:
    """key (of a class), shared: how many of the tested shingles another class shows as well."""

    def shown(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, bool]]:
        seen: set[int] = set()  # one number for each class of the task
        for texts in _portions(batches):
            for tokens in shingle_sets(as_bytes(texts.column(0)), gram):
                key = _short_key(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                if len(tokens) and key not in seen:
                    seen.add(key)
                    # Sets whose sizes make them be tested by the bounded shingles only are marked.
                    yield stand_ins(tokens, percent, True), key, len(tokens) <= SMALL_SET * percent // 100

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt_sets(shown(batches), buckets)

    def count(table: pa.Table) -> pa.Table:
        tokens, owner, keys, whole = _gathered(table)
        order = np.argsort(tokens)
        t = tokens[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        group = np.cumsum(new) - 1
        own = keys[owner[order]]
        first = np.flatnonzero(new)
        several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        # A class that several tasks have seen counts each of its shingles once.
        tested = several[group] & (whole[owner[order]] | (t < SAMPLE_BOUND))
        own, group = own[tested], group[tested]
        by = np.lexsort((group, own))
        own, group = own[by], group[by]
        once = np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])])[: len(own)]
        key, n = np.unique(own[once], return_counts=True)
        # Packed per destination: rows follow the buckets, not buckets times classes.
        return pa.table(_by_destination(key, n, buckets))

    def add(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.int64) for k in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(c, np.int64) for c in table.column("counts").to_pylist()])
        key, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "shared": pa.array(total, pa.int64())})

    dealt = docs.select(text_bytes(text)).mapInArrow(deal, _DEALT)
    found = dealt.groupBy("bucket").applyInArrow(count, "destination int, keys binary, counts binary")
    return found.groupBy("destination").applyInArrow(add, "key long, shared long")


def _by_destination(key: np.ndarray, n: np.ndarray, buckets: int) -> dict:
    place = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    parts = [np.flatnonzero(place == b) for b in range(buckets)]
    used = [(b, p) for b, p in enumerate(parts) if len(p)]
    return {
        "destination": pa.array([b for b, _ in used], pa.int32()),
        "keys": pa.array([key[p].tobytes() for _, p in used], pa.binary()),
        "counts": pa.array([n[p].astype(np.int64).tobytes() for _, p in used], pa.binary()),
    }


_DEALT = "bucket int, tokens binary, owner binary, keys binary, flags binary"


def _portions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows some megabytes at a time; between batches freed memory goes back to the system."""
    enter("ngram_join")
    for batch in batches:
        for low, rows in slices(batch, batch.nbytes):
            yield batch.slice(low, rows)
        give_back()


def _dealt_sets(sets: Iterable[tuple[np.ndarray, int, int]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``_dealt`` for (tokens, key, flag), about ``DEALT_TOKENS`` tokens at a time."""
    held, size = [], 0

    def rows() -> Iterator[pa.RecordBatch]:
        tokens, keys, flags = zip(*held, strict=True)
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(t) for t in tokens])
        return _dealt(np.concatenate(tokens), owner, np.array(keys, np.int64), np.array(flags), buckets)

    for own in sets:
        held.append(own)
        size += len(own[0])
        if size >= DEALT_TOKENS:
            yield from rows()
            held, size = [], 0
    if size:
        yield from rows()


def _dealt(tokens, owner, keys, flags, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its tokens, whose they are, and the owners' keys and flags."""
    bucket = ((tokens >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = {name: [] for name in ("bucket", "tokens", "owner", "keys", "flags")}
    for b in range(buckets):
        part = order[cuts[b] : cuts[b + 1]]
        if not len(part):
            continue
        used, local = np.unique(owner[part], return_inverse=True)
        rows["bucket"].append(b)
        rows["tokens"].append(tokens[part].tobytes())
        rows["owner"].append(local.astype(np.uint32).tobytes())
        rows["keys"].append(keys[used].tobytes())
        rows["flags"].append(flags[used].tobytes())
    yield pa.RecordBatch.from_pydict(
        rows, pa.schema([("bucket", pa.int32())] + [(n, pa.binary()) for n in ("tokens", "owner", "keys", "flags")])
    )


def _gathered(table: pa.Table):
    tokens, owner, keys, flags, base = [], [], [], [], 0
    for row in table.select(["tokens", "owner", "keys", "flags"]).to_pylist():
        k = np.frombuffer(row["keys"], np.int64)
        tokens.append(np.frombuffer(row["tokens"], np.uint64))
        owner.append(np.frombuffer(row["owner"], np.uint32).astype(np.int64) + base)
        keys.append(k)
        flags.append(np.frombuffer(row["flags"], np.uint8 if len(row["flags"]) == len(k) else np.int64))
        base += len(k)
    flat = np.concatenate(flags)
    return np.concatenate(tokens), np.concatenate(owner), np.concatenate(keys), flat.astype(bool) if flat.dtype == np.uint8 else flat


def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows with an equal first column from batches that are sorted by it."""
    now, rows = None, []
    for part in _portions(batches):
        name = part.schema.names[0]
        for row in part.to_pylist():
            if rows and row[name] != now:
                yield now, rows
                rows = []
            now = row[name]
            rows.append(row)
    if rows:
        yield now, rows


def tree_links(groups: DataFrame, gram: int, percent: int) -> DataFrame:
    """Verified links a, b inside each group; ``groups``: grp, id, part (null: own), body."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for _, rows in grouped(batches):
            if len(rows) < 2:
                continue
            sets = list(shingle_sets([r["body"] or b"" for r in rows], gram))
            kept = [i for i, s in enumerate(sets) if len(s)]
            if len(kept) < 2:
                continue
            parts = [rows[i]["id"] if rows[i]["part"] is None else rows[i]["part"] for i in kept]
            tree = PrefixTree([sets[i] for i in kept], [rows[i]["id"] for i in kept], parts, percent)
            links += _stars(tree.links())
        a, b = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = groups.select("grp", "id", "part", "body").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(search, "a long, b long").where("a <> b").distinct()


def _stars(links: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components, every node linked to the smallest one."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.setdefault(i, i) != i:
            root[i] = root.setdefault(root[i], root[i])
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(i, find(i)) for i in list(root) if find(i) != i]


def collapse_groups(survivors: DataFrame, gram: int) -> DataFrame:
    """Survivors under each of their minimum hashes; large groups are cut by a second one, then by id."""
    salts = [np.uint64(0x632BE59BD9B4E019 * (2 * r + 1) % 2**64) for r in range(2 * ROUNDS)]

    def batch(texts):
        out = {"keys": []}
        for tokens in shingle_sets(as_bytes(texts), gram):
            least = [int(mix(tokens ^ s).min()) >> 1 for s in salts] if len(tokens) else [0] * len(salts)
            out["keys"].append([[r, least[2 * r], least[2 * r + 1]] for r in range(ROUNDS)])
        return out

    keyed = annotate(survivors, [F.col("body")], batch, "keys array<array<long>>", "_keys")
    keyed = written(keyed.select("id", F.octet_length("body").cast("long").alias("bytes"), F.explode("_keys.keys").alias("k")))
    least = F.xxhash64(F.col("k")[0], F.col("k")[1])
    keyed = keyed.select("id", "bytes", least.alias("least"), F.col("k")[2].alias("second"))
    sizes = keyed.groupBy("least").agg(F.count("*").alias("size")).where("size > 1")
    chunk = F.pmod(F.xxhash64("second"), F.ceil(F.col("size") / TREE_SETS))
    chunked = written(keyed.join(sizes, "least").select("id", "bytes", F.xxhash64("least", chunk).alias("chunk")))
    needed = F.ceil(F.greatest(F.count("*") / TREE_SETS, F.sum("bytes") / TREE_BYTES, F.lit(1.0)))
    cuts = chunked.groupBy("chunk").agg(needed.cast("int").alias("cuts"), F.min("id").alias("head"))
    dealt = chunked.join(cuts, "chunk").where("cuts = 1 OR id <> head")
    dealt = dealt.select("id", F.xxhash64("chunk", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).alias("grp"))
    heads = cuts.where("cuts > 1").select(F.col("head").alias("id"), "chunk", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    chosen = dealt.union(heads.select("id", F.xxhash64("chunk", "cut").alias("grp")))
    return chosen.join(survivors, "id").select("grp", "id", F.lit(None).cast("long").alias("part"), "body")


def rest_groups(survivors: DataFrame, gram: int, percent: int) -> DataFrame:
    """Survivors that may have a link into another component, under each shingle of their prefix.

    ``survivors``: id, part (component), body.
    """
    buckets = block_count(survivors, "body", 8 << 20)

    def shown(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int, int]]:
        for rows in _portions(batches):
            ids, parts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            yield from zip(shingle_sets(as_bytes(rows.column(2)), gram), ids, parts, strict=True)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _dealt_sets(shown(batches), buckets)

    def count(table: pa.Table) -> pa.Table:
        tokens, owner, ids, parts = _gathered(table)
        parts = parts.astype(np.int64)
        order = np.lexsort((parts[owner], tokens))
        t, o = tokens[order], owner[order]
        p = parts[o]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        fresh = new | np.concatenate([[True], p[1:] != p[:-1]])
        group = np.cumsum(new) - 1
        n = np.bincount(group, weights=fresh).astype(np.int64)[group]
        several = n > 1
        t, o, n = t[several], o[several], n[several]
        by = np.argsort(o, kind="stable")
        t, o, n = t[by], o[by], n[by]
        used, low = np.unique(o, return_index=True)
        cuts = [*low.tolist(), len(o)]
        return pa.table(
            {
                "id": pa.array(ids[used], pa.int64()),
                "tokens": pa.array([t[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                "parts": pa.array([n[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            }
        )

    def prefixes(tokens, parts, sizes):
        out = {"prefix": []}
        for t, n, size in zip(tokens.to_pylist(), parts.to_pylist(), sizes.to_pylist(), strict=True):
            token = np.concatenate([np.frombuffer(x, np.uint64) for x in t])
            count = np.concatenate([np.frombuffer(x, np.int64) for x in n])
            misses = allowed_misses(size, percent)
            alone = size - len(token)  # these come first in the order and meet nothing
            if alone > misses:
                out["prefix"].append([])
                continue
            first = np.lexsort((token, count))[: misses + 1 - alone]
            out["prefix"].append(token[first].view(np.int64).tolist())
        return out

    def sizes(texts):
        return {"n": [len(s) for s in shingle_sets(as_bytes(texts), gram)]}

    dealt = survivors.select("id", "part", "body").mapInArrow(deal, _DEALT)
    found = dealt.groupBy("bucket").applyInArrow(count, "id long, tokens binary, parts binary")
    packed = found.groupBy("id").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("parts").alias("parts"))
    sized = annotate(survivors, [F.col("body")], sizes, "n long", "_n").select(
        "id", "part", F.octet_length("body").cast("long").alias("bytes"), F.col("_n.n").alias("n")
    )
    joined = packed.join(sized, "id")
    keyed = annotate(
        joined, [F.col("tokens"), F.col("parts"), F.col("n")], prefixes, "prefix array<long>", "_prefix"
    )
    keyed = written(keyed.select("id", "part", "bytes", F.explode("_prefix.prefix").alias("token")))
    needed = F.ceil(F.greatest(F.count("*") / REST_SETS, F.sum("bytes") / TREE_BYTES, F.lit(1.0))).cast("int")
    tokens = keyed.groupBy("token").agg(
        needed.alias("blocks"), F.min("id").alias("least"), (F.min("part") != F.max("part")).alias("several")
    ).where("several")
    met = written(keyed.join(tokens, "token").select("id", "bytes", "token", "blocks", "least"))
    # Sets that meet under some shingle, directly or through others, are a family: it meets
    # once as a whole.  Only families too large for one tree (in sets or bytes) meet under each shingle, block
    # against block, so that every pair shares one of the block pairs.
    families = components(met.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
    families = families.withColumnRenamed("node", "id").join(met.select("id", "bytes").distinct(), "id")
    fits = (F.count("*") <= REST_SETS) & (F.sum("bytes") <= TREE_BYTES)
    families = families.join(families.groupBy("root").agg(fits.alias("fits")), "root").select("id", "root", "fits")
    small = families.where("fits").select("id", F.xxhash64("root").alias("grp"))
    large = families.where("NOT fits").select("id")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = (
        met.join(large, "id")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    )
    return small.union(pairs).join(survivors, "id").select("grp", "id", "part", "body")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (smallest node reachable) for every node that has a link.

    Alternating star steps: each node hands its larger neighbours, then its smaller ones,
    over to the smallest.  Neighbour lists are never collected; every round is a written table.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select("v", "v").distinct()
            )
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(lower.select("u", "m")).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row."""
    rows = written(described(docs, doc_id, text, gram, percent))
    real = rows.where("klass IS NOT NULL AND id IS NOT NULL")
    classes = real.groupBy("klass").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "tested", "key")]
    )
    counts = shared_counts(docs, text, gram, percent, block_count(docs, text, 48 << 20))
    misses = F.col("n") - F.ceil(F.col("n") * percent / 100)
    chosen = (
        classes.join(counts, "key", "left")
        .where(F.coalesce("shared", F.lit(0)) >= F.col("tested") - misses)
        .select("id")
        .distinct()
    )
    bodies = docs.select(F.col(doc_id).alias("id"), text_bytes(text).alias("body"))
    survivors = written(bodies.join(chosen, "id"))
    first = written(tree_links(collapse_groups(survivors, gram), gram, percent))
    parts = components(first)
    placed = survivors.join(parts, survivors.id == parts.node, "left").select(
        "id", F.coalesce("root", "id").alias("part"), "body"
    )
    placed = written(placed)
    second = tree_links(rest_groups(placed, gram, percent), gram, percent)
    roots = components(first.union(second))
    least = classes.join(roots, classes.id == roots.node, "left").select(
        F.col("klass").alias("set"), F.coalesce("root", "id").alias("component")
    )
    joined = rows.join(least, rows.klass == least.set, "left")
    return joined.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def one_per_group(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents with their own columns, without those whose component has a smaller doc_id."""
    found = near_duplicates(docs, doc_id=doc_id, **options)
    later = found.where(F.col("component_id") < F.col(doc_id)).select(F.col(doc_id).alias("_later")).distinct()
    own = free_name(docs.columns, "_later")
    later = later.withColumnRenamed("_later", own)
    return docs.join(later, docs[doc_id] == later[own], "left_anti")
