"""Hard negatives by threshold joins on an inverted index with suffix-norm bounds.

Anchors (a fixed set of query rows) meet all rows block against block.  In a task the rows of
a block are indexed by dimension, heavy dimensions first.  For the lowest threshold of its
anchors a row leaves those trailing dimensions out of the index whose norm, times the anchors'
norm there, cannot reach it.  Partial scores are accumulated list by list; rows that cannot
reach any anchor's threshold with what norm remains are dropped on the way, and the omitted
dimensions are added for the few candidates left.

Two searches follow each other: the positives of each anchor (best rows of its label), then for
each positive the window of best rows of other labels between two shares of its score.  Each
goes over the blocks in growing stages (1 block, 8 more, 64 more, ...).  In the first stage a
task starts with a high threshold and lowers it until its windows are full; later stages start
from the score that the rows seen so far guarantee, so no row that could enter a window is ever
left out and hardly any other row leaves its task.

Defined cases: rows with a null id, label, vector or component, or a component that is not
finite, take no part; rows of one id count once, with the least label and vector; shorter
vectors are filled with zeros; components beyond 2**19 in size count as that; positives with a
negative score have no windows.  Other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.common import written

EVERY = 100  # rows whose id it divides are anchors
SHIFTED = 7  # rows whose id it divides have the next label
LABELS = 10
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # percent of the positive's score

LEAST_ROWS, MOST_ROWS, BLOCKS = 2048, 32_768, 64
ANCHOR_ROWS = 32_768  # anchors of one group
TILE = 128  # anchors that are accumulated together
CHUNK = 8  # dimensions of one step
GROWTH = 8
LARGEST = float(2**27)


# --- the index in a task ----------------------------------------------------------------


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled with zeros up to ``width``."""
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = flat.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


class SuffixIndex:
    """Rows of a block, by dimension, for one lowest threshold and the suffix norms of its anchors."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, least: float):
        order = np.argsort(-np.square(rows).sum(axis=0), kind="stable")
        self.order, self.steps = order, -(-rows.shape[1] // CHUNK)
        rows = rows[:, order]
        tail = suffix_norms(rows)
        reach = suffix_norms(anchors[:, order]).max(axis=0)
        # A row is indexed up to the first step whose suffix cannot reach the threshold.
        short = tail * reach * (1 + 1e-9) < least
        self.held = np.where(short.any(axis=1), short.argmax(axis=1), self.steps)
        self.by = np.argsort(-self.held, kind="stable")
        self.held, self.rows, self.tail = self.held[self.by], rows[self.by], tail[self.by]
        self.rest = np.where(np.arange(rows.shape[1]) // CHUNK >= self.held[:, None], self.rows, 0.0)

    def above(self, anchors: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, scores) of all rows that reach the anchor's threshold."""
        for low in range(0, len(anchors), TILE):
            x, t = anchors[low : low + TILE][:, self.order], thresholds[low : low + TILE, None]
            norms = suffix_norms(x)
            at = np.arange(int(np.count_nonzero(self.held)))
            score = np.zeros((len(x), len(at)))
            for step in range(self.steps):
                n = int(np.searchsorted(-self.held[at], -step))  # rows with more than ``step`` lists
                if not n:
                    break
                dims = slice(step * CHUNK, (step + 1) * CHUNK)
                score[:, :n] += x[:, dims] @ self.rows[at[:n], dims].T
                if step % 2 == 1 or step == self.steps - 1:
                    after = np.minimum(self.held[at], step + 1)
                    bound = score + norms[:, after] * self.tail[at, after] * (1 + 1e-9)
                    alive = (bound >= t).any(axis=0)
                    if not alive.all():
                        at, score = at[alive], score[:, alive]
            bound = score + norms[:, self.held[at]] * self.tail[at, self.held[at]] * (1 + 1e-9)
            for i in range(len(x)):
                near = np.flatnonzero(bound[i] >= t[i])
                exact = self._exact(x[i], at[near], score[i, near])
                kept = exact >= t[i]
                yield low + i, self.by[at[near[kept]]], exact[kept]

    def _exact(self, x: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        if not len(at):
            return score.astype(np.int64)
        if np.abs(x).max() * np.abs(self.rows[at]).max() * len(x) < 2.0**52:
            return np.rint(score + self.rest[at] @ x).astype(np.int64)
        return self.rows[at].astype(np.int64) @ x.astype(np.int64)


def suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Norm of what lies behind each step of ``CHUNK`` dimensions, 0 behind the last."""
    squares = np.square(rows)
    steps = range(0, rows.shape[1], CHUNK)
    parts = np.stack([squares[:, s : s + CHUNK].sum(axis=1) for s in steps] + [np.zeros(len(rows))], axis=1)
    return np.sqrt(np.cumsum(parts[:, ::-1], axis=1)[:, ::-1])


# --- windows ----------------------------------------------------------------------------


class Windows:
    """What each anchor looks for: some best rows with scores in [floor, ceiling], per window."""

    def __init__(self, size: int, same_label: bool):
        self.size, self.same_label = size, same_label

    def fill(self, ids, labels, rows, anchor_ids, anchor_labels, anchors, known, floors, ceilings) -> Iterator[tuple]:
        """(anchor, window, ids, scores); ``ids`` ascend, floors and ceilings are lists per anchor.

        ``known`` anchors have floors that rows of earlier stages guarantee.
        """
        least = np.array([min(f) for f in floors], np.float64)
        top = np.array([max(c) for c in ceilings], np.float64)
        limit = np.linalg.norm(anchors, axis=1) * np.linalg.norm(rows, axis=1).max()
        # Where nothing is known yet the threshold starts high and falls.
        start = np.minimum(top, limit) * 0.8
        now = np.where(known, least, np.maximum(least, start))
        todo = np.arange(len(anchors))
        while len(todo):
            index = SuffixIndex(rows, anchors[todo], now[todo].min())
            again = []
            for k, at, scores in index.above(anchors[todo], now[todo]):
                i = todo[k]
                fits = (labels[at] == anchor_labels[i]) == self.same_label
                fits &= ids[at] != anchor_ids[i]
                at, scores = at[fits], scores[fits]
                by = np.lexsort((at, -scores))
                at, scores = at[by], scores[by]
                found, full = [], True
                for w, (floor, ceiling) in enumerate(zip(floors[i], ceilings[i], strict=True)):
                    inside = np.flatnonzero((scores <= ceiling) & (scores >= floor))[: self.size]
                    full &= len(inside) == self.size or now[i] <= floor
                    found.append((i, w, ids[at[inside]], scores[inside]))
                if full:
                    yield from found
                else:
                    again.append(i)
            todo = np.array(again, np.int64)
            lower = 0.6 * now[todo]
            now[todo] = np.where(lower < 0.05 * limit[todo], least[todo], np.maximum(least[todo], lower))


UNBOUNDED = 2**62


def search(rows: DataFrame, anchors: DataFrame, blocks: range, windows: Windows) -> DataFrame:
    """anchor_id, slot, id, score: what each of the blocks has for each window of each anchor.

    ``rows``: vec_id, label, v, block.  ``anchors``: anchor_id, label, v, part, parts, known, floors, ceilings.
    """
    stage = rows.where((F.col("block") >= blocks.start) & (F.col("block") < blocks.stop))
    parts = anchors.select(F.first("parts")).scalar()
    left = stage.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1)))
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(blocks.start), F.lit(blocks.stop - 1))))

    def meet(own: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "slot": [], "id": [], "score": []}
        if own.num_rows and wanted.num_rows:
            own = own.sort_by("vec_id")
            width = max(1, *(pc.max(pc.list_value_length(t["v"])).as_py() for t in (own, wanted)))
            anchor_ids = wanted["anchor_id"].to_numpy()
            found = windows.fill(
                own["vec_id"].to_numpy(), own["label"].to_numpy(), matrix(own["v"], width), anchor_ids, wanted["label"].to_numpy(),
                matrix(wanted["v"], width), wanted["known"].to_numpy(), wanted["floors"].to_pylist(), wanted["ceilings"].to_pylist(),
            )
            for i, slot, ids, scores in found:
                out["anchor_id"].append(np.full(len(ids), anchor_ids[i]))
                out["slot"].append(np.full(len(ids), slot, np.int32))
                out["id"].append(ids)
                out["score"].append(scores)
        kinds = {"anchor_id": np.int64, "slot": np.int32, "id": np.int64, "score": np.int64}
        return pa.table({c: np.concatenate([np.zeros(0, kinds[c]), *out[c]]).astype(kinds[c]) for c in out})

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, _FOUND)


_FOUND = "anchor_id long, slot int, id long, score long"


def fill_windows(rows: DataFrame, blocks: int, anchors: DataFrame, windows: Windows) -> DataFrame:
    """The first ``windows.size`` rows of every window, over growing stages of blocks.

    ``anchors``: anchor_id, label, v, part, ceilings and floors (what the windows reach down to).
    """
    best, low, step = None, 0, 1
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    state = anchors.withColumn("known", F.lit(False))
    while low < blocks:
        found = search(rows, state, range(low, min(blocks, low + step)), windows)
        known = found if best is None else best.drop("rank").union(found)
        best = written(known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= windows.size))
        # The last row of a full window is as good as its last row can finally be.
        last = F.map_from_entries(F.collect_list(F.struct("slot", "score")))
        full = best.where(F.col("rank") == windows.size).groupBy("anchor_id").agg(last.alias("last"))
        raised = F.expr("transform(floors, (f, i) -> greatest(f, coalesce(try_element_at(last, i), f)))")
        state = anchors.join(full, "anchor_id", "left").withColumns(
            {"floors": raised, "known": F.coalesce(F.size("last") == F.size("floors"), F.lit(False))}
        )
        low, step = low + step, step * GROWTH
    return best


# --- the operator -----------------------------------------------------------------------


def usable(embeddings: DataFrame, *, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, label (shifted), v: components floor(256 x) of the rows that take part."""
    x = F.col("x")
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = embeddings.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & sound)
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c * SCALE))).cast("int"))
    moved = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct(moved.alias("label"), scaled.alias("v"))).alias("row"))
    return one.select("vec_id", "row.label", "row.v")


def hard_negatives(embeddings: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = written(usable(embeddings, vec_id=vec_id, vector=vector, label=label))
    count = rows.count()
    size = min(MOST_ROWS, max(LEAST_ROWS, count // BLOCKS))
    blocks = max(1, -(-count // size))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    parts = max(1, -(-anchors.count() // ANCHOR_ROWS))
    part = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(parts)).cast("int")
    # A table of its own: Spark refuses to co-group two frames over the same columns of one table.
    anchors = written(anchors.select(F.col("vec_id").alias("anchor_id"), "label", "v", part.alias("part"), F.lit(parts).alias("parts")))

    first = anchors.withColumns({"ceilings": F.array(F.lit(UNBOUNDED)), "floors": F.array(F.lit(0).cast("long"))})
    positives = fill_windows(rows, blocks, first, Windows(POSITIVES, True))
    positives = positives.select(
        "anchor_id", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    scores = F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"])
    wanted = positives.groupBy("anchor_id").agg(scores.alias("scores"))
    ends = {"floors": F.expr(f"transform(scores, s -> (s * {LOW} + 99) div 100)"), "ceilings": F.expr(f"transform(scores, s -> s * {HIGH} div 100)")}
    second = written(anchors.join(wanted, "anchor_id").withColumns(ends).drop("scores"))
    found = fill_windows(rows, blocks, second, Windows(NEGATIVES, False))
    return found.join(positives, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
