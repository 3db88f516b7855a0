from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.test_ngram_join import UPPER, family
from vitalspan.llm import minhash_dedup
from vitalspan.llm.minhash_dedup import most_differing_bits, near_duplicates, odd_sketches, samples, without_near_copies


def shingles(text: str | None) -> set:
    words = [w for w in (text or "").translate(UPPER).replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(frame) -> dict[int, tuple]:
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame).collect()}


def test_equals_brute_force(docs, texts):
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    want = brute([(7 * i - 20, t) for i, t in enumerate(texts)])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == want


@pytest.mark.parametrize("rounds", [0, 1])
def test_families_with_links_and_near_misses(spark, monkeypatch, rounds):
    """Members on both sides of the similarity; without leader rounds the rest alone finds all links."""
    monkeypatch.setattr(minhash_dedup, "LEADER_ROUNDS", rounds)
    monkeypatch.setattr(minhash_dedup, "REST_SETS", 7)
    monkeypatch.setattr(minhash_dedup, "LEADER_TESTS", 3)
    rng = random.Random(4)
    texts = [t for size in (10, 60, 150, 400) for t in family(rng, 30, size, max(1, size // 35))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(frame) == brute(rows)


def test_one_large_family_is_dealt_out(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[: 7 + i % 200] + [f"new{i}"] + base[8 + i % 200 :])) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {c for _, c, _ in got(frame).values()} == {0}
    members = spark.createDataFrame([(i, 10, [0] * 8, i) for i in range(700)], "id long, n long, sketch array<long>, part long")
    pairs = members.where("id > 0").selectExpr("id", "0L AS leader")
    bodies = frame.selectExpr("doc_id AS id", "CAST(text AS BINARY) AS body")
    assert minhash_dedup.confirmed(pairs, bodies, 5, 85).count() == 699


def test_odd_sketches_estimate_high_similarities():
    """The flipped bits of two sketches follow the expected number for their similarity."""
    rng = np.random.default_rng(0)
    for share, low, high in ((0.0, 0, 0), (0.02, 2, 40), (0.08, 20, 90)):
        found = []
        for _ in range(20):
            a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            b = a.copy()
            b[: int(2000 * share)] = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
            x, y = odd_sketches(samples([np.sort(a), np.sort(b)])).view(np.uint64)
            found.append(int(np.bitwise_count(x ^ y).sum()))
        assert low <= np.mean(found) <= high
    assert 90 < most_differing_bits() < 170


def test_kept_documents_and_clashing_columns(docs, texts, no_docs, clashing):
    want = brute([(7 * i - 20, t) for i, t in enumerate(texts)])
    kept = without_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, _, k) in want.items() if k}
    assert without_near_copies(no_docs).count() == 0 and near_duplicates(no_docs).count() == 0
    assert without_near_copies(clashing).count() == 3
    nobody = near_duplicates(clashing).where("doc_id IS NULL").first()
    assert (nobody.n_shingles, nobody.component_id, nobody.kept) == (1, None, None)
