from __future__ import annotations

import random
import zlib

import pytest

from vitalspan.llm.bpe import Table
from vitalspan.llm.toxicity import Lexicon, learn, predictions, quoted, weighted_hits, without_toxic

TERMS = ["rascal", "nitwit", "villain", "oaf"]


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(after[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(4)
    lexicon = Lexicon(TERMS)
    for _ in range(2000):
        word = list(rng.choice(TERMS))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(word) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                word.insert(at, rng.choice("abcdel"))
            elif word and kind == 1:
                del word[min(at, len(word) - 1)]
            elif word:
                word[min(at, len(word) - 1)] = rng.choice("abcdel")
        text = "".join(word)
        want = any(edits(text, t) <= 1 for t in TERMS if len(t) >= 5)
        assert (lexicon.near(text) is not None) is want, text
    assert lexicon.lookup(b"oaf") == ("oaf", 0) and lexicon.lookup(b"oak") is None


def test_context_tells_quotation_from_abuse():
    known = Table(Lexicon(TERMS).lookup)
    said = b'They wrote "you rascal" in the letter'
    meant = b"They wrote you rascal in the letter"
    assert quoted(said, said.index(b"rascal"), said.index(b"rascal") + 6)
    assert weighted_hits(said, known)[0] < weighted_hits(meant, known)[0]
    assert weighted_hits(b"rascal nitwit", known)[0] > 2 * weighted_hits(b"rascal", known)[0]
    assert weighted_hits(b"", known)[:3] == (0.0, 0.0, 0)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(rng.randint(2, 4) if toxic else 0):
            own.insert(rng.randrange(len(own) + 1), rng.choice(TERMS))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, toxic if i % 10 else None))
    rows += [(900, None), (901, ""), (902, "x " * 20000)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = predictions(docs, labels).collect()
    assert len(got) == 903
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    plain = {r.score for r in got if r.doc_id >= 900}
    assert len(plain) == 1 and plain.pop() < 0.7


def test_learns_only_from_allowed_rows(corpus):
    docs, labels = corpus
    model = learn(docs, labels)
    allowed = labels.where("crc32(cast(doc_id AS string)) % 3 <> 1")
    assert learn(docs, allowed) == model
    assert set(model.terms) == set(TERMS)


def test_filter_and_missing_labels(corpus, no_docs, clashing):
    docs, labels = corpus
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and 700 < kept.count() < 800
    assert without_toxic(docs, labels.limit(0)).count() == docs.count()
    assert without_toxic(no_docs, labels).count() == 0
    assert without_toxic(clashing, labels).columns == clashing.columns
