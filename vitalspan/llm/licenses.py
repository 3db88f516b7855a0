"""Licence scans: template markup compiled into token automata.

A template is wording with marked regions, as in licence list templates:

* ``<<beginOptional>> ... <<endOptional>>``: wording that may be missing (may nest);
* ``<<var;max=N>>``: a replaceable region of up to N words.

Compiling gives a nondeterministic automaton over words.  Matching starts where the first
mandatory run of words stands (found by plain search in the normalised text), walks the
automaton word by word and accepts when all mandatory wording has been read in order,
exactly.  Case, punctuation and white space do not matter, since words are
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.

Besides templates, phrases of a fixed list are counted at every place they stand.

Score: ``FULL`` when a whole licence text is accepted, to the last word of its disclaimer or
conditions, ``NOTICE`` for a licence notice, ``PARTIAL`` for the opening of a licence text whose
rest is missing or changed, ``PHRASE`` when only phrases stand, else 0.  The opening that the
BSD licences share has the label of the family.  Apache and GPL have notices only.

Defined cases: null and empty texts have no words and score 0; overlapping places all
count; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import alnum_words, annotate, as_bytes, text_bytes

FULL, NOTICE, PARTIAL, PHRASE = 1.0, 0.9, 0.7, 0.5

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public licence wording.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=4>> software and
    associated documentation files (the <<var;max=1>> Software <<var;max=1>>), to deal in the Software without
    restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
    sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
    so, subject to the following conditions: The above copyright notice and this permission notice
    <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial
    portions of the Software."""
_MIT_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
    LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
    SHALL <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
    OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
    SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=12>> BE LIABLE
    FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
    DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
    CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: <<var;max=1>> Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer. <<var;max=1>> Redistributions in binary form must
    reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution."""
_BSD_ADVERTISING = """<<var;max=1>> All advertising materials mentioning features or use of this software must display
    the following <<var;max=1>> This product includes software developed by <<var;max=20>>"""
_BSD_NAMES = """<<var;max=1>> Neither the name of <<var;max=12>> nor the names of <<var;max=2>> contributors may be used
    to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
    BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
    NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
    DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
    BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
    (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided as is, without any express or implied warranty. In no event will the authors be
    held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
    software for any purpose, including commercial applications, and to alter it and redistribute it freely"""
_ZLIB_RESTRICTIONS = """, subject to the following restrictions: <<var;max=1>> The origin of this software must not be
    misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
    <<var;max=1>> in the product documentation would be appreciated but is not required. <<var;max=1>> Altered source
    versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;max=1>>
    This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
    publish, use, compile, sell, or distribute this software"""
_UNLICENSE_REST = """, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial,
    and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
    and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public
    at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of
    relinquishment in perpetuity of all present and future rights to this software under copyright law."""

# label, score, template.
TEMPLATES = [
    ("mit", FULL, f"{_MIT} {_MIT_DISCLAIMER}"),
    ("mit", PARTIAL, _MIT),
    ("isc", FULL, f"{_ISC} {_ISC_DISCLAIMER}"),
    ("isc", PARTIAL, _ISC),
    ("bsd-2-clause", FULL, f"{_BSD} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", FULL, f"{_BSD} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd-4-clause", FULL, f"{_BSD} {_BSD_ADVERTISING} {_BSD_NAMES} {_BSD_DISCLAIMER}"),
    ("bsd", PARTIAL, _BSD),
    ("zlib", FULL, f"{_ZLIB} {_ZLIB_RESTRICTIONS}"),
    ("zlib", PARTIAL, _ZLIB),
    ("unlicense", FULL, f"{_UNLICENSE} {_UNLICENSE_REST} {_MIT_DISCLAIMER}"),
    ("unlicense", PARTIAL, _UNLICENSE),
    (
        "apache-2",
        NOTICE,
        """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the License); you may not use this file
        except in compliance with the License<<endOptional>>""",
    ),
    ("mit", NOTICE, "<<beginOptional>>is<<endOptional>> released under the MIT License"),
    ("mit", NOTICE, "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT license"),
    (
        "gpl-3",
        NOTICE,
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<var;max=2>> version 3
        <<beginOptional>>or any later version<<endOptional>>""",
    ),
    (
        "gpl-2",
        NOTICE,
        """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License
        <<beginOptional>>as published by the Free Software Foundation<<endOptional>> <<var;max=2>> version 2
        <<beginOptional>>or any later version<<endOptional>>""",
    ),
    ("cc-by-nc", NOTICE, "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<beginOptional>>SA<<endOptional>> 4.0"),
    ("cc-by", NOTICE, "licensed under <<beginOptional>>a<<endOptional>> CC BY <<beginOptional>>SA<<endOptional>> 4.0"),
    (
        "cc-by-nc",
        NOTICE,
        """licensed under <<var;max=1>> Creative Commons Attribution-NonCommercial <<beginOptional>>ShareAlike<<endOptional>>
        4.0 International <<beginOptional>>Public<<endOptional>> License""",
    ),
]

_MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")


def parse(template: str) -> list:
    """Nested parts: words (bytes), ("optional", parts), ("var", most words)."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += alnum_words(template[at : m.start()].encode())
        at = m.end()
        if m.group(1) == "beginOptional":
            stack.append([])
        elif m.group(1) == "endOptional":
            if len(stack) == 1:
                raise ValueError("optional region ends before it begins")
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("var", int(m.group(2))))
    stack[-1] += alnum_words(template[at:].encode())
    if len(stack) != 1:
        raise ValueError("optional region does not end")
    return stack[0]


@dataclass
class Automaton:
    """States 0..n; ``step[s]``: word -> states, ``free[s]``: states after any word, ``jump[s]``: without a word."""

    label: str
    score: float
    anchor: bytes
    step: list[dict[bytes, list[int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    jump: list[list[int]] = field(default_factory=list)
    accept: int = 0

    def state(self) -> int:
        self.step.append({})
        self.free.append([])
        self.jump.append([])
        return len(self.step) - 1

    def closure(self, states: Iterable[int]) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo += self.jump[s]
        return seen

    def match(self, words: list[bytes], start: int) -> int | None:
        """Word after the shortest accepted run that begins at ``start``."""
        now = self.closure([0])
        at = start
        while True:
            if self.accept in now:
                return at
            if at >= len(words) or not now:
                return None
            after: list[int] = []
            for s in now:
                after += self.step[s].get(words[at], ())
                after += self.free[s]
            now = self.closure(after)
            at += 1


def compile_template(label: str, score: float, template: str) -> Automaton:
    """Automaton of the wording from its first mandatory word on.

    Regions before that word may be missing, so they decide nothing and are left out.
    """
    parts = parse(template)
    while parts and not isinstance(parts[0], bytes):
        parts.pop(0)
    lead = []
    for part in parts:
        if not isinstance(part, bytes):
            break
        lead.append(part)
    if len(lead) < 2:
        raise ValueError("a template needs two mandatory words in a row before its first region")
    automaton = Automaton(label, score, b" ".join(lead))
    end = _build(automaton, parts, automaton.state())
    automaton.accept = end
    return automaton


def _build(a: Automaton, parts: list, at: int) -> int:
    for part in parts:
        if isinstance(part, bytes):
            after = a.state()
            a.step[at].setdefault(part, []).append(after)
        elif part[0] == "optional":
            after = _build(a, part[1], at)
            if after != at:
                a.jump[at].append(after)
        else:
            after = a.state()
            a.jump[at].append(after)
            here = at
            for _ in range(part[1]):
                more = a.state()
                a.free[here].append(more)
                a.jump[more].append(after)
                here = more
        at = after
    return at


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands in the words joined as `` w w w ``."""
    out, at, words, counted = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        out.append(words)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, float, str]]):
        self.phrases = [(b" ".join(alnum_words(p.encode())), label) for p, label in phrases.items()]
        self.automata = [compile_template(*t) for t in templates]

    def scan(self, text: bytes) -> dict:
        words = alnum_words(text)
        joined = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            if phrase in joined and (found := places(joined, phrase)):
                starts += found
                base.add(label)
        labels, score, matches = set(base), PHRASE if base else 0.0, []
        for a in self.automata:
            if a.anchor not in joined:
                continue
            for start in places(joined, a.anchor):
                end = a.match(words, start)
                if end is not None:
                    matches.append({"label": a.label, "first": start, "last": end - 1})
                    labels.add(a.label)
                    score = max(score, a.score)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": score,
            "matches": matches,
        }


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "matches array<struct<label: string, first: long, last: long>>"
)


def scan(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    phrases: dict[str, str] | None = None,
    templates: list[tuple[str, float, str]] | None = None,
) -> DataFrame:
    """One row per document: counts and places of phrases, labels, score, and accepted template spans."""
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def batch(texts):
        found = [scanner.scan(t) for t in as_bytes(texts)]
        names = [n for n, _ in (part.strip().split(" ", 1) for part in RESULT.split(", ")[:7])] + ["matches"]
        return {name: [f[name] for f in found] for name in names}

    rows = annotate(docs.select(doc_id, text), [text_bytes(text)], batch, RESULT, "_licence")
    return rows.select(F.col(doc_id), "_licence.*")


def template_pattern(template: str) -> str:
    """The same acceptance as a regular expression over the words joined as `` w w w ``."""

    def write(parts: list) -> str:
        out = ""
        for part in parts:
            if isinstance(part, bytes):
                out += f"{part.decode()} "
            elif part[0] == "optional":
                out += f"(?:{write(part[1])})?"
            else:
                out += f"(?:[^ ]+ ){{0,{part[1]}}}"
        return out

    parts = parse(template)
    while parts and not isinstance(parts[0], bytes):
        parts.pop(0)
    return " " + write(parts)
