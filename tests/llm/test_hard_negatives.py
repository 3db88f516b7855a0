from __future__ import annotations

import math
import random

import numpy as np
import pytest

from vitalspan.llm import hard_negatives
from vitalspan.llm.hard_negatives import SuffixIndex

COLUMNS = "vec_id long, embedding array<float>, label int"
hard = hard_negatives.hard_negatives


def brute(rows: list[tuple]) -> set[tuple]:
    best: dict[int, tuple] = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x])
        best[i] = min(best.get(i, row), row)
    out = set()
    for a, (label, v) in best.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in best.items() if i != a)
        for p, positive in [(-s, i) for s, i in scores if best[i][0] == label][:5]:
            fits = [(-s, i) for s, i in scores if best[i][0] != label and 30 * p <= -100 * s <= 90 * p]
            out |= {(a, positive, r, i, p, s) for r, (s, i) in enumerate(fits[:10], 1)}
    return out


def got(frame) -> set[tuple]:
    rows = [tuple(r) for r in hard(frame).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 4)


def vectors(n: int, dims: int, seed: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(10))
        x = 0.25 * centres[label] + rng.normal(size=dims) * 0.3
        if i % 9 == 0:
            x = centres[3]  # one vector of many rows
        rows.append((i, (x / np.linalg.norm(x)).astype(np.float32).tolist(), label))
    return rows


def test_equals_brute_force(spark, small_blocks):
    rows = vectors(900, 20, 5)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert got(frame) == brute(rows)


def test_nulls_ties_lengths_and_repeated_rows(spark, small_blocks):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 1.0]) for _ in range(rng.choice([3, 5, 0]))], rng.randint(0, 2)) for i in range(-150, 250)]
    rows += [(0, [9.0], 1), (100, [1e30, 2.0], 1), (None, [1.0], 1), (3, None, 1), (5, [1.0], None), (200, [None, 1.0], 2)]
    rows += [(-100, [float("nan")], 2), (104, [float("inf")], 2), rows[7], rows[150]]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows if r[0] != 100], COLUMNS + ", block int, score string")
    assert got(frame) == brute([r for r in rows if r[0] != 100])
    assert hard(spark.createDataFrame(rows, COLUMNS)).count() > 0  # sizes beyond the stated bound do not stop it


def test_empty_table_and_missing_labels(spark):
    assert hard(spark.createDataFrame([], COLUMNS)).count() == 0
    assert hard(spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], COLUMNS)).count() == 0


def test_index_omits_dimensions_and_loses_nothing():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(400, 40)) * np.linspace(1, 0.02, 40))
    anchors = rows[:30]
    exact = anchors @ rows.T
    for share in (0.9, 0.3, 0.0):
        limits = share * np.square(anchors).sum(axis=1)
        index = SuffixIndex(rows, anchors, limits.min())
        if share == 0.9:
            assert index.held.mean() < index.steps / 2
        for i, at, scores in index.above(anchors, limits):
            want = np.flatnonzero(exact[i] >= limits[i])
            assert sorted(at.tolist()) == want.tolist() and (exact[i, at] == scores).all()
