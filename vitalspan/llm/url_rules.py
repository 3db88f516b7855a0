"""URL filters: fixed rules first, then association rules mined from what they decide.

A fixed rule names a host and the start of a path; it fits the host and its subdomains, and
the longest fitting rule wins.  Its verdicts are labels: combinations of URL tokens (host
parts, path parts, file ending, query keys) are mined together with the label, and rules
"tokens -> verdict" of enough support and confidence judge the URLs that no fixed rule
fits.  A rule that a shorter one of no less confidence implies is dropped.  At matching, an
inverted index lists each rule under its rarest token, so a URL looks only at rules that one
of its tokens names.

Support bounds the rules, at every size the same: a token set must occur with a verdict in a
share ``SUPPORT`` of all labelled URLs and in ``LEAST_URLS`` of them.  There is no bound on the
number of rules.

Mining goes level by level over the distinct sets of frequent tokens.  Only sets that a rule
could still come from are extended: no token may be dropped without more URLs fitting (k
tokens that always occur together are k sets, not 2^k), and the URLs must have different
verdicts.  All other sets have rules that a shorter rule implies, and so do all larger ones.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no
rule; without any matching mined rule, or without labelled URLs, the verdict is ``allow``;
repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import annotate, free_name, written

SUPPORT = 0.005
CONFIDENCE = 0.8
LEAST_URLS = 20
PORTION_SETS = 200_000
ALLOW, BLOCK = "allow", "block"
VERDICTS = (ALLOW, BLOCK)

# Verdict, host, start of the path.
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(raw) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _UPPER.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(rule_host + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""

    def named(kind: str, parts: Column) -> Column:
        kept = F.filter(parts, lambda p: p != "")
        return F.transform(kept, lambda p: F.concat(F.lit(kind), p))

    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda q: F.substring_index(q, "=", 1))
    return F.array_distinct(
        F.concat(
            named("host:", F.split(host, r"[.\-]")),
            named("site:", F.array(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))),
            named("path:", segments),
            named("ending:", F.array(F.regexp_extract(last, r"\.([A-Za-z0-9]+)$", 1))),
            named("key:", keys),
            named("part:", F.array(F.when(url.contains("#"), "fragment").otherwise(""))),
        )
    )


@dataclass
class Rules:
    """Mined rules under their rarest token."""

    found: list[tuple[frozenset[str], str, float, float]] = field(default_factory=list)

    def __post_init__(self):
        counts: dict[str, int] = defaultdict(int)
        for items, *_ in self.found:
            for t in items:
                counts[t] += 1
        self.index: dict[str, list[tuple]] = defaultdict(list)
        for items, verdict, confidence, support in self.found:
            self.index[min(items, key=lambda t: (counts[t], t))].append((items, verdict, confidence, support))

    def judge(self, items: set[str]) -> str | None:
        """Verdict of the most confident matching rule; then support, then the tokens decide."""
        best = None
        for token in items & self.index.keys():
            for rule in self.index[token]:
                if rule[0] <= items:
                    rank = (rule[2], rule[3], sorted(rule[0]))
                    if best is None or rank > best[0]:
                        best = (rank, rule[1])
        return best and best[1]


def pruned(rows: Iterable[tuple[Iterable[str], str, float, float]]) -> list[tuple[frozenset[str], str, float, float]]:
    """Rules without those that a rule on fewer of their tokens implies with no less confidence."""
    kept: dict[frozenset[str], tuple[str, float, float]] = {}
    index: dict[str, list[frozenset[str]]] = defaultdict(list)
    for items, verdict, confidence, support in sorted(rows, key=lambda r: (len(r[0]), sorted(r[0]), r[1])):
        own = frozenset(items)
        shorter = {s for t in own for s in index[t] if s < own}
        if any(kept[s][0] == verdict and kept[s][1] >= confidence for s in shorter):
            continue
        kept[own] = (verdict, confidence, support)
        for t in own:
            index[t].append(own)
    return [(items, *rest) for items, rest in kept.items()]


def candidates(tree: dict, known: frozenset[tuple[int, ...]], depth: int, items: list[int]) -> Iterator[tuple[int, ...]]:
    """Sets of ``depth + 1`` of the sorted items of which every set of ``depth`` is known.

    ``tree`` holds the known sets as paths.
    """

    def walk(node: dict, at: int, path: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        here = [(i, t) for i, t in enumerate(items[at:], at) if t in node]
        if len(path) < depth - 1:
            for i, t in here:
                yield from walk(node[t], i + 1, (*path, t))
            return
        for n, (_, first) in enumerate(here):
            for _, second in here[n + 1 :]:
                own = (*path, first, second)
                if all(own[:k] + own[k + 1 :] in known for k in range(depth - 1)):
                    yield own

    return walk(tree, 0, ())


def _counted(baskets: DataFrame, known: Iterable[tuple[int, ...]], depth: int, least: int) -> dict[tuple[int, ...], list[int]]:
    """URLs (all, allowed, blocked) of every frequent set of ``depth + 1`` tokens with only known sets below it."""
    known, tree = frozenset(known), {}
    for path in known:
        node = tree
        for t in path:
            node = node.setdefault(t, {})
    names = ["n", *VERDICTS]
    schema = "tokens array<int>, " + ", ".join(f"{v} long" for v in names)

    def portion(counts: dict) -> pa.RecordBatch:
        columns = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.list_(pa.int32())), *columns], ["tokens", *names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, ...], list[int]] = {}
        for batch in batches:
            for items, *own in zip(*(batch.column(c).to_pylist() for c in ("ids", *names)), strict=True):
                for c in candidates(tree, known, depth, items):
                    have = counts.setdefault(c, [0] * len(own))
                    for k, v in enumerate(own):
                        have[k] += v
                if len(counts) >= PORTION_SETS:
                    yield portion(counts)
                    counts = {}
        yield portion(counts)

    sums = baskets.mapInArrow(count, schema).groupBy("tokens").agg(*[F.sum(v).alias(v) for v in names])
    return {tuple(r[0]): list(r[1:]) for r in sums.where(F.greatest(*VERDICTS) >= least).collect()}


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> Rules:
    """Rules from rows of items (array of tokens) and verdict."""
    n = labelled.count()
    least = max(math.ceil(support * n), LEAST_URLS)
    urls = [F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]]
    single = labelled.select(F.explode(F.array_distinct("items")).alias("token"), "verdict").groupBy("token").agg(*urls)
    frequent = sorted(single.where(F.greatest(*VERDICTS) >= least).collect(), key=lambda r: (r.n, r.token))
    names = [r.token for r in frequent]
    number = {t: i for i, t in enumerate(names)}

    def batch(items):
        return {"ids": [sorted({number[t] for t in row if t in number}) for row in items.to_pylist()]}

    name = free_name(labelled.columns, "_known")
    known = annotate(labelled.where("items IS NOT NULL"), [F.col("items")], batch, "ids array<int>", name)
    known = known.select(F.col(name)["ids"].alias("ids"), "verdict")
    baskets = written(known.groupBy("ids").agg(*urls)) if frequent else None

    found, depth = [], 1
    level = {(i,): list(r[1:]) for i, r in enumerate(frequent)}
    # Of the sets one token shorter: their counts, and the highest confidence of themselves and what they contain.
    below: dict[tuple[int, ...], tuple[list[int], list[float]]] = {}
    while level:
        kept = {}
        for own, counts in level.items():
            parts = [below[own[:k] + own[k + 1 :]] for k in range(depth)] if depth > 1 else []
            if any(have[0] == counts[0] for have, _ in parts):
                continue
            best = [max((b[v] for _, b in parts), default=-1.0) for v in range(len(VERDICTS))]
            shares = [c / counts[0] for c in counts[1:]]
            for v, verdict in enumerate(VERDICTS):
                if counts[v + 1] >= least and shares[v] >= confidence and shares[v] > best[v]:
                    found.append((frozenset(names[t] for t in own), verdict, shares[v], counts[v + 1] / n))
            if max(shares) < 1:
                kept[own] = (counts, [max(pair) for pair in zip(best, shares, strict=True)])
        level = _counted(baskets, kept, depth, least) if len(kept) > 1 else {}
        below, depth = kept, depth + 1
    return Rules(found)


def judged(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), list(rules)))
    rows = rows.withColumn("items", tokens(F.coalesce("url", F.lit("")), F.col("host"), F.col("path")))
    labelled = rows.where("fit IS NOT NULL").select("items", F.col("fit.verdict").alias("verdict"))
    mined = mine(labelled, support=support, confidence=confidence)

    def batch(items):
        return {"verdict": [mined.judge(set(i or [])) for i in items.to_pylist()]}

    name = free_name(rows.columns, "_mined")
    rows = annotate(rows, [F.col("items")], batch, "verdict string", name)
    return rows.select(
        F.col("id").alias(page_id),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.col(name)["verdict"], F.lit(ALLOW)).alias("verdict"),
    )
