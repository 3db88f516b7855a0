"""MinHash near duplicates: banded candidates, checked by odd sketches, confirmed on full sets.

A document's set is its distinct 5-word shingles; equal sets are one class.  Each class has
``BANDS * ROWS`` MinHash samples.  Samples are banded into buckets (two sets of similarity 0.85
miss all bands once in 10**10 times), and all of them are folded into an odd sketch: a bitmap in
which every (sample number, value) flips one bit.  The population count of the XOR of two sketches
tells how many samples differ, most precisely where nearly none do; pairs whose count is above
what a similarity of 0.85 gives once in 10**9 times are no candidates.  Every link is confirmed on
whole sets.

Pairs of a bucket are never all listed:

1. *Leaders.*  One class of each bucket, chosen by a hash, meets the others; each class is tested
   against the leader with the nearest sketch.  Confirmed links are contracted to components.  A
   leader's tests are dealt over several tasks.  Further rounds choose other leaders; one is enough
   to leave little for the next step.
2. *Rest.*  Buckets that still hold several components meet once more, together with those that
   share their classes where that moves fewer rows.  The classes outside the most frequent component
   meet all classes, block against block, by sketch first; only what has a near sketch in another
   component is compared by its whole set.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are their
own component; texts under five words are one shingle; repeated rows share a component; rows
without doc_id get null as component and ``kept``.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import annotate, as_bytes, mix, slices, text_bytes, written
from vitalspan.llm.ngram_join import components, shingle_sets
from vitalspan.operators.prefilter import rows_that_may_match

GRAM = 5
PERCENT = 85
BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
BITS = 512
LOST = 1e-9  # share of links that the sketch filter may lose
LEADER_ROUNDS = 1
LEADER_TESTS = 256  # tests of one leader in one group
REST_SETS, REST_SHINGLES = 2000, 4_000_000  # of one block
PIECE = 1 << 17  # shingles that are sampled together

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


# --- samples, bands, sketches -----------------------------------------------------------


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per set that is not empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat(flat * factor, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket per set and band."""
    grid = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), grid.shape[:2])
    for j in range(ROWS):
        key = mix(key * _MULTIPLIER + grid[:, :, j])
    return key.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Bitmaps in which every (sample number, value) flips one bit, as 64-bit words."""
    place = (mix(values ^ _PLACES) % np.uint64(BITS)).astype(np.int64)
    rows = np.arange(len(values))[:, None] * BITS
    flips = np.bincount((rows + place).ravel(), minlength=len(values) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(values), BITS), axis=1).view(np.int64)


def most_differing_bits(percent: int = PERCENT, lost: float = LOST) -> int:
    """Population count that the XOR of two sketches exceeds with probability ``lost`` at this similarity."""
    # Chance that k of the samples differ, then of the number of odd bits after 2 k flips.
    miss = 1 - percent / 100
    differ = np.array([1.0])
    for _ in range(SAMPLES):
        differ = np.convolve(differ, [1 - miss, miss])
    odd, total = np.zeros(BITS + 1), np.zeros(BITS + 1)
    odd[0], counts = 1.0, np.arange(BITS + 1)
    for k in range(SAMPLES + 1):
        total += differ[k] * odd
        for _ in range(2):
            up, down = odd * (BITS - counts) / BITS, odd * counts / BITS
            odd = np.concatenate([[0.0], up[:-1]]) + np.concatenate([down[1:], [0.0]])
    return int(np.flatnonzero(np.cumsum(total[::-1])[::-1] > lost)[-1])


def sketch_distance(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    place = np.searchsorted(b, a)
    common = int(np.count_nonzero(b[np.minimum(place, len(b) - 1)] == a))
    return common * (100 + percent) >= percent * (len(a) + len(b))


def described(docs: DataFrame, doc_id: str, text: str, gram: int) -> DataFrame:
    """id, n (size of the set), klass (digest of the set), bands, sketch; null for empty sets."""

    def batch(texts):
        out = {"n": [], "klass": [], "bands": [], "sketch": []}
        waiting: list[np.ndarray] = []

        def flush():
            if waiting:
                values = samples(waiting)
                out["bands"] += list(band_keys(values))
                out["sketch"] += list(odd_sketches(values))
                waiting.clear()

        for tokens in shingle_sets(as_bytes(texts), gram):
            out["n"].append(len(tokens))
            if not len(tokens):
                flush()
                out["bands"].append(None)
                out["sketch"].append(None)
            out["klass"].append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            if len(tokens):
                waiting.append(tokens)
                if sum(map(len, waiting)) > PIECE or len(waiting) >= 512:
                    flush()
        flush()
        return out

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body"))
    found = annotate(rows, [text_bytes("body")], batch, "n long, klass binary, bands array<long>, sketch array<long>", "_set")
    return found.select("id", "_set.*")


# --- leaders ----------------------------------------------------------------------------


def leader_pairs(met: DataFrame, members: DataFrame, turn: int, bits: int, percent: int) -> DataFrame:
    """id, leader: for each class the leader of another component with the nearest sketch."""
    rank = F.xxhash64("id") if turn == 0 else F.xxhash64("id", "bucket", F.lit(turn))
    leaders = met.groupBy("bucket").agg(F.min_by("id", F.struct(rank, "id")).alias("leader"))
    pairs = met.join(leaders, "bucket").where("id <> leader").select("id", "leader").distinct()
    head = members.select(
        F.col("id").alias("leader"), F.col("n").alias("leader_n"), F.col("sketch").alias("leader_sketch"), F.col("part").alias("leader_part")
    )
    both = pairs.join(members, "id").join(head, "leader")
    distance = sketch_distance("sketch", "leader_sketch")
    sizes = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    near = both.where((F.col("part") != F.col("leader_part")) & sizes).withColumn("distance", distance).where(F.col("distance") <= bits)
    return near.groupBy("id").agg(F.min_by("leader", F.struct("distance", "leader")).alias("leader"))


def confirmed(pairs: DataFrame, bodies: DataFrame, gram: int, percent: int) -> DataFrame:
    """a, b: the pairs (id, leader) whose whole sets are linked."""
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_TESTS).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    tests = pairs.join(counts, "leader").select(F.xxhash64("leader", cut).alias("grp"), "leader", "id", F.lit(1).alias("turn"))
    heads = counts.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    heads = heads.select(F.xxhash64("leader", "cut").alias("grp"), "leader", F.col("leader").alias("id"), F.lit(0).alias("turn"))

    def test(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []
        for batch in batches:
            links = []
            for low, rows in slices(batch, batch.nbytes):
                part = batch.slice(low, rows)
                sets = shingle_sets(as_bytes(part.column("body")), gram)
                columns = (part.column(c).to_pylist() for c in ("grp", "leader", "id", "turn"))
                for tokens, grp, leader, i, turn in zip(sets, *columns, strict=True):
                    if (grp, leader) != now:
                        now, own = (grp, leader), []
                    if turn == 0:
                        own.append(tokens)
                    elif len(tokens) and any(linked(tokens, head, percent) for head in own):
                        links.append((i, leader))
            yield _links(links)

    dealt = tests.union(heads).join(bodies, "id").select("grp", "leader", "turn", "id", "body")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", "leader", "turn", "id")
    return dealt.mapInArrow(test, "a long, b long").distinct()


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# --- the rest ---------------------------------------------------------------------------


def open_groups(met: DataFrame, members: DataFrame) -> DataFrame:
    """grp, id, asks: classes of buckets with several components, block against block.

    Buckets that share classes are put into one family (whole buckets, so no pair of a bucket is
    lost).  A family meets once as a whole where that moves fewer rows than meeting in each of its
    buckets.  In what meets, the classes outside the most frequent component ask, and all classes
    answer.
    """
    placed = met.select("bucket", "id").join(members.select("id", "part", "n"), "id")
    several = placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("id").alias("head"))
    rows = written(placed.join(several.where("low <> high").select("bucket", "head"), "bucket"))
    low = rows.groupBy("id").agg(F.min("head").alias("low"))
    roots = rows.join(low, "id").groupBy("bucket").agg(F.min("low").alias("root"))
    rows = written(rows.join(roots, "bucket").select("root", "bucket", "id", "part", "n"))
    whole = rows.groupBy("root", "id").agg(F.first("part").alias("part"), F.first("n").alias("n"))

    by_bucket, by_family = _grid(rows, ["root", "bucket"]), _grid(whole, ["root"])
    costs = by_bucket.groupBy("root").agg(F.sum("moved").alias("apart"))
    together = costs.join(by_family, "root").withColumn("as_one", F.col("moved") <= F.col("apart"))
    single = together.where("as_one").select("root", "main", "blocks", "askers")
    apart = by_bucket.join(together.where("NOT as_one").select("root"), "root", "left_semi")
    one = _asked(whole.join(single, "root"), F.xxhash64("root"))
    rest = _asked(rows.join(apart.select("bucket", "main", "blocks", "askers"), "bucket"), F.xxhash64("root", "bucket"))
    return one.union(rest)


def _grid(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: the most frequent component, blocks of answers and of asking classes, rows that these move."""
    parts = rows.groupBy(*group, "part").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sums = parts.groupBy(*group).agg(
        F.sum("size").alias("size"), F.sum("shingles").alias("shingles"), F.max("size").alias("main_size"),
        F.max_by("part", F.struct("size", "part")).alias("main"),
    )
    asking = F.col("size") - F.col("main_size")
    blocks = F.ceil(F.greatest(F.col("size") / REST_SETS, F.col("shingles") / REST_SHINGLES)).cast("int")
    sums = sums.withColumns({"blocks": blocks, "askers": F.ceil(blocks * asking / F.col("size")).cast("int")})
    moved = F.col("size") * F.col("askers") + asking * F.col("blocks")
    return sums.select(*group, "main", "blocks", "askers", moved.alias("moved"))


def _asked(rows: DataFrame, name: Column) -> DataFrame:
    """Every answer under each block of asking classes, every asking class under each block of answers."""
    place = F.xxhash64("id")
    answers = rows.select(
        "id", name.alias("name"), F.pmod(place, F.col("blocks")).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), F.col("askers") - 1)).alias("ask"), F.lit(False).alias("asks"),
    )
    asks = rows.where("part <> main").select(
        "id", name.alias("name"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"),
        F.pmod(place, F.col("askers")).cast("int").alias("ask"), F.lit(True).alias("asks"),
    )
    return answers.union(asks).select(F.xxhash64("name", "own", "ask").alias("grp"), "id", "asks")


class _Parts:
    """Components known so far and those joined in a task."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, i: int) -> int:
        root = self.root
        while root.setdefault(i, i) != i:
            root[i] = root.setdefault(root[i], root[i])
            i = root[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def _candidates(table: pa.Table, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each asking row the answering rows of other components with a near sketch."""
    sketches = np.stack(table["sketch"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)).view(np.uint64)
    part, asks = table["part"].to_numpy(), table["asks"].to_numpy()
    answers = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks):
        distance = np.bitwise_count(sketches[answers] ^ sketches[i]).sum(axis=1)
        yield i, answers[(distance <= bits) & (part[answers] != part[i])]


def rest_links(met: DataFrame, members: DataFrame, bodies: DataFrame, bits: int, gram: int, percent: int) -> DataFrame:
    """a, b: links that the leaders have not shown."""

    def near(table: pa.Table) -> pa.Table:
        chosen = np.zeros(table.num_rows, bool)
        for i, at in _candidates(table, bits):
            chosen[at] = True
            chosen[i] |= len(at) > 0
        return table.filter(pa.array(chosen))

    def confirm(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(as_bytes(table["body"].combine_chunks()), gram))
        ids, part, parts, links = table["id"].to_pylist(), table["part"].to_pylist(), _Parts(), []
        for i, at in _candidates(table, bits):
            for j in at.tolist():
                if parts.find(part[i]) != parts.find(part[j]) and linked(sets[i], sets[j], percent):
                    parts.join(part[i], part[j])
                    links.append((ids[i], ids[j]))
        return pa.Table.from_batches([_links(links)])

    columns = "grp long, asks boolean, id long, part long, sketch array<long>"
    groups = open_groups(met, members).join(members.select("id", "part", "sketch"), "id").select("grp", "asks", "id", "part", "sketch")
    found = written(groups.groupBy("grp").applyInArrow(near, columns))
    return found.join(bodies, "id").select("grp", "asks", "id", "part", "sketch", "body").groupBy("grp").applyInArrow(confirm, "a long, b long")


# --- the operator -----------------------------------------------------------------------


def with_parts(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with their component so far."""
    roots = components(links)
    placed = members.drop("part").join(roots, members.id == roots.node, "left")
    return written(placed.select("id", "n", "sketch", F.coalesce("root", "id").alias("part")))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, percent: int = PERCENT
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept for every row."""
    bits = most_differing_bits(percent)
    rows = written(described(docs, doc_id, text, gram))
    classes = rows.where("klass IS NOT NULL AND id IS NOT NULL").groupBy("klass").agg(
        F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    )
    classes = written(classes)
    banded = classes.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    met = written(rows_that_may_match(banded, shared, ["bucket"]).join(shared, "bucket").select("bucket", "id"))
    members = classes.join(met.select("id").distinct(), "id").select("id", "n", "sketch", F.col("id").alias("part"))
    members = written(members)
    # Few documents share a bucket: the others' texts are dropped before the exchange.
    bodies = docs.select(F.col(doc_id).cast("long").alias("id"), text_bytes(text).alias("body"))
    bodies = rows_that_may_match(bodies, members, ["id"])
    wanted = members.select(F.col("id").alias("wanted"))
    bodies = written(bodies.join(wanted, bodies.id == wanted.wanted, "left_semi"))

    links = docs.sparkSession.createDataFrame([], "a long, b long")
    for turn in range(LEADER_ROUNDS):
        pairs = written(leader_pairs(met, members, turn, bits, percent))
        links = written(links.union(confirmed(pairs, bodies, gram, percent)))
        members = with_parts(members, links)
    rest = rest_links(met, members, bodies, bits, gram, percent)
    roots = components(links.union(rest))
    least = classes.join(roots, classes.id == roots.node, "left").select(
        F.col("klass").alias("set"), F.coalesce("root", "id").alias("component")
    )
    joined = rows.join(least, rows.klass == least.set, "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )


def without_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents, with their own columns, that are the smallest of their component (or have no doc_id)."""
    later = near_duplicates(docs, doc_id=doc_id, **options).where("NOT kept").select(F.col(doc_id).alias("later")).distinct()
    return docs.join(later, docs[doc_id] == later["later"], "left_anti")
