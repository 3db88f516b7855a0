from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vitalspan.llm.bpe import ByteBpe, decoded, encoded, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return ByteBpe(PATH)


def test_random_texts_equal_the_library(library, own):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "<|endoftext|>", "'s", "'ll", " ", "　", "\x85", "\x1c", "#", "日本", "the", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = library.encode(text, add_special_tokens=False).ids
        got = [i for p in own.pieces(text.encode()) for i in own.encode_piece(p)]
        assert got == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ab" * 3000, "x" * 5000, "the" * 400 + "é" * 300, "ﬁ՘ა" * 50])
def test_long_words_and_rare_letters_equal_the_library(library, own, text):
    assert own.encode(text.encode()) == library.encode(text, add_special_tokens=False).ids


def test_whole_table(docs, texts, library, no_docs, clashing):
    for r in round_trip(docs, PATH).collect():
        text = texts[(r.doc_id + 20) // 7] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert round_trip(no_docs, PATH).count() == 0
    assert round_trip(clashing, PATH).count() == 3


def test_ids_and_back(docs, texts):
    back = decoded(encoded(docs, PATH).drop("text"), PATH)
    assert set(back.columns) == {*docs.columns, "ids"}
    assert all(r.text == (texts[(r.doc_id + 20) // 7] or "") for r in back.collect())
