from __future__ import annotations

import hashlib
import random
import re

import pytest

from vitalspan.llm.decontaminate import Matcher, contamination, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text: str | None, items: list[tuple[str, str | None]], window: int = 13):
    words = WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, body in items:
        own = WORD.findall((body or "").translate(UPPER))
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    rng = random.Random(3)
    long = [t for t in texts if t and len(t.split()) > 40]
    items = [(str(i), " ".join(t.split()[5 : 5 + rng.randint(10, 30)])) for i, t in enumerate(long[:12])]
    items += [("short", "A b"), ("none", None), ("blank", " ."), ("same", items[0][1]), ("other", "nothing of this " * 6)]
    return spark.createDataFrame(items, "item_id string, text string"), items


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 150])
def test_equals_brute_force_in_one_or_many_blocks(docs, benchmark, texts, pattern_bytes):
    frame, items = benchmark
    got = contamination(docs, frame, pattern_bytes=pattern_bytes).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        want = brute(texts[(r.doc_id + 20) // 7], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def test_filter_keeps_clean_documents_and_their_columns(docs, benchmark, texts, clashing, no_docs):
    frame, items = benchmark
    kept = without_contaminated(docs, frame)
    assert kept.columns == docs.columns
    want = sorted(7 * i - 20 for i, t in enumerate(texts) if not brute(t, items)[4])
    twice = 7 * 30 - 20
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want + [twice] * (twice in want))
    assert without_contaminated(clashing, frame).columns == clashing.columns
    assert without_contaminated(clashing, frame).count() == 3
    assert without_contaminated(no_docs, frame).count() == 0
    assert without_contaminated(docs, frame.limit(0)).count() == docs.count()


def test_overlapping_occurrences_of_one_pattern():
    ranges, items = Matcher([("i", b"a a a")], 3).find([b"a"] * 6)
    assert [r[0] for r in ranges] == [0, 1, 2, 3] and items == {"i"}
