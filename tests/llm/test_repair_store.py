from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitalspan.llm import repair_store
from vitalspan.llm.repair_store import (
    compress,
    document_digests,
    expand,
    read_shards,
    shard_row,
    store_and_digest,
    token_range,
    write_tokens,
)

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("n", "kinds"), [(0, 3), (1, 3), (2, 1), (1000, 1), (1001, 1), (5000, 3), (20000, 50)])
def test_grammar_round_trip_and_random_access(n, kinds):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, kinds, n).astype(np.uint32)
    symbols, rules = compress(ids, 1 << 16)
    assert (expand(symbols, rules, 1 << 16) == ids).all()
    if n:
        row = shard_row(0, 0, [1], [n], ids)
        for _ in range(40):
            a = int(rng.integers(0, n))
            b = int(rng.integers(a, n)) + 1
            assert (token_range(row, a, b) == ids[a:b]).all()
        assert n < 500 or len(row["high"]) < n


def test_files_equal_the_library(spark, docs, texts, no_docs, tmp_path):
    library = Tokenizer.from_file(PATH)
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    want, start = [], 0
    for doc, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder = str(tmp_path / "tokens")
    write_tokens(docs, folder, PATH, shard=500)
    shards = read_shards(spark, folder)
    assert shards.count() > 3
    got = sorted(tuple(r) for r in document_digests(shards).collect())
    assert got == sorted(want)
    assert sorted(tuple(r) for r in store_and_digest(docs, PATH).collect()) == sorted(want)
    assert store_and_digest(no_docs, PATH).count() == 0


def odd_texts() -> list[str]:
    rng = random.Random(4)
    chars = [chr(c) for c in range(0x260)] + list("日٣Ⅷ²  　’😀́")
    some = [f"ab{c}cd {c}x x{c} {c}{c} {c}\n{c}1{c}" for c in chars] + chars
    odd = [*"aabcXYZé×÷ñÿ  019.,;!'\n\n\t-_ 日½", "'s", "'ll", " '", " can't", "<|endoftext|>", "  ", " \n", "\0"]
    plain = [*"aabcXYZéñÿ 019.,;!\n-_"]
    for _ in range(2000):
        some.append("".join(rng.choice(odd) for _ in range(rng.randint(0, 25))))
        some.append(" ".join("".join(rng.choice(plain) for _ in range(rng.randint(0, 25))).split(" ")).strip(" "))
    return some


@pytest.mark.parametrize(("words", "size"), [(1 << 21, 4 << 20), (300, 20_000)])
def test_encoder_equals_the_library(monkeypatch, words, size):
    monkeypatch.setattr(repair_store, "WORDS_KEPT", words)
    monkeypatch.setattr(repair_store, "BYTES_AT_ONCE", size)
    texts = odd_texts()
    raw, encoder, got = [t.encode() for t in texts], repair_store.Encoder(PATH), []
    for few in repair_store._portions(raw):
        got += encoder.encode(raw[few])
    want = Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def test_each_word_goes_through_the_library_once():
    encoder, calls = repair_store.Encoder(PATH), []

    class Counted:
        def tokenize(self, word, model=encoder.model):
            calls.append(word)
            return model.tokenize(word)

    encoder.model = Counted()
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    encoder.encode([f"{w} {w}. {w},\n{w}; é{w}".encode() for w in words])
    few = len(calls)
    assert few == len(set(calls))
    encoder.encode([" ".join(f"{w}; {w}. é{w}," for w in reversed(words)).encode()])
    # The first word of a text has no space, and "é..." has one now.
    assert len(calls) == len(set(calls)) and len(calls) - few <= 2
