from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from vitalspan.llm.url_rules import RULES, Rules, host_and_path, judged, mine, pruned, tokens

URLS = [
    "http://a.example.com/en/1.html",
    "https://www.example.com/en/x?q=1#f",
    "HTTPS://WWW.Example.COM/en",
    "http://example.net/es/1",
    "http://b.example.net/fr/2?x",
    "http://b.example.net/de/2?x",
    "http://com/",
    "http://com",
    "http://telecom/en/",
    "ftp://x.org?a=b/c",
    "no scheme /en/",
    "://",
    "",
    None,
]


def expected(url: str | None) -> tuple[str, str, str | None, str | None]:
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = None
    for verdict, own, start in RULES:
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            if best is None or len(own + start) > len(best[0]):
                best = (own + start, verdict)
    return host, path, *(best or (None, None))


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for r in judged(pages).collect():
        host, path, rule, verdict = expected(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or (verdict is None and r.verdict in ("allow", "block"))


def test_mined_rules_equal_brute_force(spark):
    urls = [f"http://h{i % 3}.example.{t}/{p}/{i}.html" for i in range(60) for t, p in (("com", "en"), ("net", "fr"), ("com", "de"))]
    frame = spark.createDataFrame([(u,) for u in urls], "url string")
    host, path = host_and_path(F.col("url"))
    verdict = F.when(F.col("url").contains("/en/") | F.col("url").contains("net"), "block").otherwise("allow")
    rows = frame.select(tokens(F.col("url"), host, path).alias("items"), verdict.alias("verdict"))
    data = [(frozenset(r.items), r.verdict) for r in rows.collect()]
    sets, labelled = Counter(), Counter()
    for items, v in data:
        frequent = [i for i in items if sum(i in d for d, _ in data) >= 0.2 * len(data)]
        for k in range(1, len(frequent) + 1):
            for c in combinations(sorted(frequent), k):
                sets[frozenset(c)] += 1
                labelled[frozenset(c), v] += 1
    want = [(s, v, n / sets[s], n / len(data)) for (s, v), n in labelled.items() if n >= 0.2 * len(data) and n / sets[s] >= 0.8]
    got = mine(rows, support=0.2, confidence=0.8)
    assert {(s, v) for s, v, *_ in got.found} == {(s, v) for s, v, *_ in pruned(want)}
    assert all(got.judge(set(items)) == v for items, v in data)


def test_index_finds_every_matching_rule():
    rules = Rules([(frozenset("ab"), "block", 0.9, 0.1), (frozenset("b"), "allow", 0.85, 0.2), (frozenset("c"), "block", 0.8, 0.3)])
    assert rules.judge({"a", "b"}) == "block"
    assert rules.judge({"b"}) == "allow"
    assert rules.judge({"c", "x"}) == "block"
    assert rules.judge({"x"}) is None and rules.judge(set()) is None


def test_empty_table_and_clashing_names(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert judged(pages).count() == 0
    rows = [(1, "http://x.org/a", "x", "y"), (1, "http://x.org/a", "x", "y")]
    got = judged(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].verdict == "allow"


def test_many_rules_keep_the_support(spark):
    """16 tokens that always occur together have 65,535 antecedents, more than were once allowed."""
    together = [f"t{k}" for k in range(16)]
    rows = [([*together, f"p{i}"], "block") for i in range(30)]
    rows += [(["b", "c"] if i % 2 else ["b"], "allow" if i % 2 else "block") for i in range(60)]
    got = mine(spark.createDataFrame(rows, "items array<string>, verdict string"), support=0.2)
    assert {(s, v) for s, v, *_ in got.found} == {(frozenset([t]), "block") for t in together} | {(frozenset("c"), "allow")}
    assert got.judge({"t7", "new"}) == "block" and got.judge({"b", "c"}) == "allow"


def test_implied_and_mixed_tokens_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        items = {t for t, share in zip("abcdef", (0.9, 0.6, 0.5, 0.5, 0.4, 0.3), strict=True) if rng.random() < share} | {"all"}
        items |= {"x"} if "a" in items else set()
        items |= {"y", "z"} if {"b", "c"} <= items else set()
        rows.append((sorted(items), "block" if (len(items & set("bde")) + (rng.random() < 0.1)) % 2 else "allow"))
    sets, labelled = Counter(), Counter()
    for items, v in rows:
        for k in range(1, len(items) + 1):
            for c in combinations(items, k):
                sets[frozenset(c)] += 1
                labelled[frozenset(c), v] += 1
    want = [(s, v, n / sets[s], n / len(rows)) for (s, v), n in labelled.items() if n >= 20 and n / sets[s] >= 0.6]
    got = mine(spark.createDataFrame(rows, "items array<string>, verdict string"), support=0.05, confidence=0.6)
    assert set(got.found) == set(pruned(want)) and max(len(s) for s, *_ in got.found) > 2
