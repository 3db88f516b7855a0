from __future__ import annotations

import re

import pytest

from vitalspan.llm.licenses import FULL, PARTIAL, TEMPLATES, Scanner, compile_template, parse, scan, template_pattern
from vitalspan.llm.common import alnum_words

TEMPLATE = "grant of rights <<beginOptional>>to all <<beginOptional>>of<<endOptional>> you<<endOptional>> by <<var;max=2>> holder"


def accepts(text: str) -> bool:
    automaton, words = compile_template("x", 1.0, TEMPLATE), alnum_words(text.encode())
    return any(automaton.match(words, i) is not None for i in range(len(words)))


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("Grant of rights by holder", True),
        ("the GRANT of, rights to all you by the only holder!", True),
        ("grant of rights to all of you by holder", True),
        ("grant of rights to you by holder", False),
        ("grant of rights by one two three holder", False),
        ("grant of right by holder", False),
        ("grant of rights by holders", False),
        ("", False),
    ],
)
def test_regions(text, wanted):
    assert accepts(text) is wanted
    joined = " " + " ".join(w.decode() for w in alnum_words(text.encode())) + " "
    assert bool(re.search(template_pattern(TEMPLATE), joined)) is wanted


@pytest.mark.parametrize("template", [t for _, _, t in TEMPLATES])
def test_every_template_accepts_its_mandatory_wording(template):
    def words(parts, optional):
        for part in parts:
            if isinstance(part, bytes):
                yield part
            elif part[0] == "optional" and optional:
                yield from words(part[1], optional)

    for optional in (False, True):
        text = b" before ".join([b"", b" ".join(words(parse(template), optional)), b""])
        label = next(name for name, _, t in TEMPLATES if t == template)
        assert label in Scanner({}, TEMPLATES).scan(text)["labels"].split(",")
    mandatory = list(words(parse(template), False))
    broken = b" ".join([*mandatory[:2], *[b"other"] * 9, *mandatory[2:]])
    assert Scanner({}, [("x", 1.0, template)]).scan(broken)["labels"] == ""


@pytest.mark.parametrize("bad", ["a b <<beginOptional>> c", "a b <<endOptional>>", "a <<var;max=1>> b"])
def test_broken_markup_is_refused(bad):
    with pytest.raises(ValueError):
        compile_template("x", 1.0, bad)


def test_places_and_scores(spark, no_docs, clashing):
    rows = [
        (1, "Under the MIT license, under the mit License. CC-BY-NC"),
        (2, "Released under the MIT License."),
        (3, "Licensed under the Apache License, Version 2.0."),
        (4, None),
        (5, "under the mit licenses"),
        (5, "under the mit licenses"),
    ]
    got = [r.asDict() for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_base"], by[1]["first_word"], by[1]["last_word"], by[1]["base_labels"]) == (3, 0, 8, "cc-by-nc,mit")
    assert by[1]["score"] == 0.5
    assert (by[2]["labels"], by[2]["score"], by[2]["first_word"]) == ("mit", 0.9, 1)
    assert (by[3]["labels"], by[3]["n_words"]) == ("apache-2", 8)
    assert (by[4]["n_words"], by[4]["labels"], by[4]["score"], by[4]["first_word"]) == (0, "", 0.0, None)
    assert by[5]["n_base"] == 0 and len(got) == 6
    assert scan(no_docs).count() == 0
    assert scan(clashing).count() == 3


def test_full_needs_the_last_word_of_the_licence():
    scanner = Scanner({}, TEMPLATES)
    full = {name: t for name, score, t in TEMPLATES if score == FULL}
    assert {"mit", "isc", "zlib", "unlicense", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause"} == set(full)
    for name, template in full.items():
        words = re.sub("<<.*?>>", " ", template).split()
        family = name.split("-")[0]
        whole = scanner.scan(" ".join(words).encode())
        assert (set(whole["labels"].split(",")), whole["score"]) == ({name, family}, 1.0)
        for cut in (words[:-1], [*words[:-9], "only", *words[-9:]]):
            got = scanner.scan(" ".join(cut).encode())
            assert (got["labels"], got["score"]) == (family, PARTIAL)
    extra = full["mit"].replace("THE SOFTWARE IS PROVIDED", "The Software shall be used for Good, not Evil. THE SOFTWARE IS PROVIDED")
    assert scanner.scan(re.sub("<<.*?>>", " ", extra).encode())["score"] == PARTIAL
