from __future__ import annotations

import random

import pytest

from vitalspan.llm import ngram_join
from vitalspan.llm.ngram_join import PrefixTree, components, near_duplicates, one_per_group, shingle_sets

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> set:
    words = (text or "").translate(UPPER).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
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
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture
def small_groups(monkeypatch):
    """Chunks and block pairs are met on small data as well."""
    monkeypatch.setattr(ngram_join, "TREE_SETS", 3)
    monkeypatch.setattr(ngram_join, "REST_SETS", 3)


def family(rng: random.Random, n: int, size: int, changes: int) -> list[str]:
    words = [f"w{rng.randint(0, 400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(words)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(size)] = f"c{rng.randint(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_equals_brute_force(docs, texts):
    want = brute([(7 * i - 20, t) for i, t in enumerate(texts)])
    got = near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_families_of_near_copies_in_small_groups(spark, small_groups):
    rng = random.Random(11)
    texts = [t for size in (12, 60, 150, 400) for t in family(rng, 25, size, max(1, size // 40))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == brute(rows)


def test_tree_finds_every_link_between_components():
    rng = random.Random(2)
    texts = family(rng, 60, 40, 2) + family(rng, 60, 40, 2)
    sets = list(shingle_sets([t.encode() for t in texts]))
    want = brute(list(enumerate(texts)))
    tree = PrefixTree(sets, list(range(len(sets))), None, 85)
    for a, b in tree.links():
        assert want[a][1] == want[b][1]
    roots: dict[int, int] = {}
    for i in range(len(sets)):
        roots[i] = tree.find(i)
    assert {frozenset(i for i in roots if roots[i] == r) for r in roots.values()} == {
        frozenset(i for i in want if want[i][1] == r) for _, r in want.values()
    }


def test_one_document_of_each_group_stays(docs, texts, no_docs, clashing):
    kept = one_per_group(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, root) in brute([(7 * i - 20, t) for i, t in enumerate(texts)]).items() if i == root}
    assert {r.doc_id for r in kept.collect()} == want
    assert one_per_group(no_docs).count() == 0
    assert one_per_group(clashing).count() == 3


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame(chain + star, "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(links.limit(0)).count() == 0


def test_family_of_near_copies_is_dealt_out(spark, monkeypatch):
    """Near copies share the second minimum hash too; parts by id stay small and one component."""
    from pyspark.sql import functions as F

    from vitalspan.llm import ngram_join

    monkeypatch.setattr(ngram_join, "TREE_SETS", 8)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(80):
        words = list(base)
        words[(i * 3 + 7) % 300] = f"new{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    body = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("body"))
    for bound, most in (("TREE_SETS", 8), ("TREE_BYTES", 8 * len(rows[0][1]))):
        with monkeypatch.context() as m:
            m.setattr(ngram_join, "TREE_SETS", 10**6)
            m.setattr(ngram_join, bound, most)
            groups = ngram_join.collapse_groups(body, 4).groupBy("grp").count().collect()
            assert max(r["count"] for r in groups) <= 24
    assert {r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {0}
