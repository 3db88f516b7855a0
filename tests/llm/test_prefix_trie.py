from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from vitalspan.llm.prefix_trie import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> dict[tuple[int, int], tuple]:
    """Rows of the contract, by walking every prefix of every rebuilt conversation."""
    turns: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn, role or "", text or ""))

    def key(t):
        turn, role, text = t
        size = len(role.encode())
        name = hashlib.md5(f"{size}:{role}{text}".encode()).digest()
        return turn is not None, turn or 0, name

    lists = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = tuple(lists.get(base, [])[:h]) + tuple(own[h:])
    nodes: dict[tuple, list[int]] = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    children: dict[tuple, int] = dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        own = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    out = {}
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(p))))
        out[min(members), len(p)] = (
            min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def got(frame) -> dict:
    rows = frame.collect()
    out = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows
    }
    assert len(out) == len(rows)
    return out


def conversations(seed: int, n: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    shared = [(rng.choice(["user", "assistant", None]), rng.choice(["é", "", None, "hi", "x" * 50])) for _ in range(longest)]
    rows = []
    for c in rng.sample(range(-40, 400), n):
        length = rng.choice([1, 2, 3, 7, 8, 9, 16, 17, longest])
        keep = rng.randint(0, length)
        for turn in range(length):
            role, text = shared[turn] if turn < keep else (rng.choice(["user", "assistant"]), f"t{rng.randint(0, 3)}")
            rows.append((c, turn, role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 8])
def test_equals_brute_force(spark, width):
    rows = conversations(3, 120, 41)
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    assert got(prefix_trie(frame, width=width)) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"), (5, None, "user", "first"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"),
        (6, 2, "assistant", "b"), (7, 0, None, None), (-7, 3, "user", None), (-5, 0, "user", "a"), (11, 0, "user", "zz"),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS + ", depth string, name int")
    assert got(prefix_trie(frame)) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], COLUMNS)).count() == 0


def test_copies_of_one_conversation(spark):
    """Every conversation says the same: one path, whose ends are the members of each length."""
    rows = [(c, t, "user", f"t{t}") for c in range(0, 300) for t in range(12)]
    assert got(prefix_trie(spark.createDataFrame(rows, COLUMNS))) == brute(rows)
