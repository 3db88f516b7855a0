from __future__ import annotations

import random

import numpy as np
import pytest

from vitalspan.llm.quality_cnn import CHUNK, WIDTH, Network, as_codes, chunk_starts, predictions

from .conftest import prose


@pytest.mark.parametrize("n", [0, 1, WIDTH, CHUNK - 1, CHUNK, CHUNK + 1, 5 * CHUNK + 3, 200_000])
def test_chunks_cover_the_whole_text(n):
    starts = chunk_starts(n)
    assert starts[0] == 0 and starts[-1] + CHUNK >= n
    assert all(b - a <= CHUNK - WIDTH for a, b in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("n", [0, 3, 100, CHUNK + 1, 70_000])
def test_scoring_equals_direct_convolution(n):
    rng = np.random.default_rng(n)
    network = Network(
        rng.normal(size=(WIDTH, 257, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), rng.normal(size=8), 0.1
    )
    text = bytes(rng.integers(32, 127, n).astype(np.uint8))
    codes = as_codes(text)
    pooled = []
    for s in chunk_starts(len(codes)):
        chunk = codes[s : s + CHUNK]
        response = [
            sum(network.tables[k][chunk[i + k]] for k in range(WIDTH)) for i in range(len(chunk) - WIDTH + 1)
        ]
        pooled.append(np.maximum(np.max(response, axis=0) + network.bias, 0))
    want = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    assert np.allclose(network.pooled(text), want, atol=1e-4)


def test_held_out_accuracy_and_cases(spark, no_docs, clashing):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        words = prose(rng, rng.randint(4, 200)).split(" ")
        bad = i % 4 == 0
        rows.append((i, " ".join(w + (rng.choice(["###", "$$$"]) if bad else "") for w in words)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(500, None), (501, ""), (502, prose(rng, 20_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = predictions(docs, truth).collect()
    known = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(got) == 503 and len(held) > 100
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in predictions(clashing, truth.limit(0)).collect()} == {0.5}
    assert predictions(no_docs, truth).count() == 0
