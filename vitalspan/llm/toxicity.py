"""Toxicity from a learned lexicon, its misspellings, and the context of each hit.

The lexicon holds words that occur in toxic training documents and hardly in others.  A
document word is looked up by walking the lexicon's trie together with the Levenshtein
automaton of the word: a node carries the automaton state (one row of edit distances), and
a subtree is left as soon as no entry of the row is within the allowed distance.  Short
words must match exactly; a misspelling counts only for terms whose near words are not
used by clean training documents.

Each hit is weighted by its context window: inside quotation marks it counts for little
(somebody is quoted), near other hits for more.  A logistic model turns the weighted hits
into one probability.

Learning is bounded: at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other rows that may
be learned from, chosen by a hash, one per family of near copies.  Scoring covers every
word of every document.

Defined cases: null and empty texts get the score of a text without hits; rows without
label, or with several, are learned from once per label row; repeated rows get equal
scores; without any toxic or any clean training row every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.bpe import Table
from vitalspan.llm.common import alnum_words, annotate, as_bytes, free_name, held_out, mix, text_bytes
from vitalspan.llm.ngram_join import shingle_sets

SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 14_000
CHANCE = 1e-5  # a term's documents are all toxic by chance with at most this probability
PRECISION = 0.85
KNOWN_WORDS = 100_000
FUZZY_LENGTH = 5
QUOTED, ALONE, NEAR = 0.3, 1.0, 1.25
CONTEXT_BYTES = 80
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_PAIRS = (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"))


# --- lexicon trie and automaton ------------------------------------------------------------


class Lexicon:
    """Trie of terms, searched with the Levenshtein automaton of a word."""

    def __init__(self, terms: Iterable[str], fuzzy: set[str] | None = None):
        self.terms = sorted(set(terms))
        self.fuzzy = set(self.terms) if fuzzy is None else fuzzy
        self.trie: dict = {}
        for term in self.terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        self.exact = {t.encode(): t for t in self.terms}
        long = [t for t in self.fuzzy if len(t) >= FUZZY_LENGTH]
        # One edit leaves the first or the last half of a term as it is.
        self.heads = {t[: len(t) // 2] for t in long}
        self.tails = {t[len(t) - len(t) // 2 :] for t in long}
        self.halves = sorted({len(t) // 2 for t in long})

    def near(self, word: str, most: int = 1) -> str | None:
        """A fuzzy term within ``most`` edits of the word (not equal to it), or None."""
        if len(word) < FUZZY_LENGTH - most or not any(
            word[:k] in self.heads or word[-k:] in self.tails for k in self.halves
        ):
            return None
        stack = [(self.trie, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            term = node.get("")
            if term is not None and row[-1] <= most and len(term) >= FUZZY_LENGTH and term in self.fuzzy:
                return term
            for c, child in node.items():
                if not c:
                    continue
                after = [row[0] + 1]
                for i, have in enumerate(word):
                    after.append(min(after[i] + 1, row[i + 1] + 1, row[i] + (have != c)))
                if min(after) <= most:
                    stack.append((child, after))
        return None

    def lookup(self, word: bytes) -> tuple[str, int] | None:
        """(term, edits) for a document word."""
        term = self.exact.get(word)
        if term is not None:
            return term, 0
        term = self.near(word.decode("utf-8", "replace")) if self.fuzzy else None
        return None if term is None else (term, 1)


def quoted(text: bytes, start: int, end: int) -> bool:
    """Whether the span stands between an opening and a closing quotation mark nearby."""
    left = text[max(0, start - CONTEXT_BYTES) : start].decode("utf-8", "ignore")
    right = text[end : end + CONTEXT_BYTES].decode("utf-8", "ignore")
    if left.count('"') % 2 and '"' in right:
        return True
    return any(left.rfind(a) > left.rfind(b) and b in right for a, b in _PAIRS if a in left)


def weighted_hits(text: bytes, known: Table) -> tuple[float, float, int, list[str]]:
    """Weight of exact hits, of misspelled hits, number of words, terms hit by misspellings."""
    words = alnum_words(text)
    found = list(map(known.__getitem__, words))
    if not any(found):
        return 0.0, 0.0, len(words), []
    hits = [i for i, f in enumerate(found) if f]
    spans = {}
    want = set(hits)
    for i, m in enumerate(_WORD.finditer(text)):
        if i in want:
            spans[i] = m.span()
    weight, misspelled, terms = [0.0, 0.0], 0, []
    for n, i in enumerate(hits):
        close = (n and i - hits[n - 1] <= 10) or (n + 1 < len(hits) and hits[n + 1] - i <= 10)
        factor = QUOTED if quoted(text, *spans[i]) else NEAR if close else ALONE
        term, edits = found[i]
        weight[edits > 0] += factor
        if edits:
            misspelled += 1
            terms.append(term)
    return weight[0], weight[1], len(words), terms


def features(exact: float, near: float) -> list[float]:
    """What the model sees; not the length, so that abuse cannot hide in a long text."""
    return [1.0, float(np.log1p(exact)), float(np.log1p(near))]


# --- learning --------------------------------------------------------------------------


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    fuzzy: set[str] = field(default_factory=set)
    weights: list[float] | None = None

    def score(self, exact: float, near: float) -> float:
        if self.weights is None:
            return 0.0
        z = float(np.dot(self.weights, features(exact, near)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sizes: dict[int, int], doc_id: str, text: str) -> DataFrame:
    """id, y, body of a bounded number of rows per label that may be learned from."""
    usable = labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(list(sizes)))
    usable = usable.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    order = F.xxhash64("id", F.lit(label))
    chosen = None
    for y, size in sizes.items():
        part = usable.where(F.col("y") == y).orderBy(order, "id").limit(size)
        chosen = part if chosen is None else chosen.union(part)
    # Bounded by the sizes: at most that many (id, label) pairs.
    rows = docs.select(F.col(doc_id).alias("id"), text_bytes(text).alias("body"))
    return rows.join(F.broadcast(chosen), "id")


def one_per_family(rows: DataFrame) -> DataFrame:
    """One row per label and least shingle, so that near copies are learned from once."""

    def batch(texts):
        return {"family": [int(mix(s).min() >> np.uint64(1)) if len(s) else 0 for s in shingle_sets(as_bytes(texts))]}

    keyed = annotate(rows, [F.col("body")], batch, "family long", "_f")
    return keyed.groupBy("y", F.col("_f.family").alias("family")).agg(F.min_by("body", "id").alias("body"))


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = {0: Counter(), 1: Counter()}
    for batch in batches:
        for y, body in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            seen[y].update(set(alnum_words(body)))
    words = list(seen[0] | seen[1])
    columns = [pa.array(words, pa.binary())] + [pa.array([seen[y][w] for w in words], pa.int64()) for y in (0, 1)]
    yield pa.RecordBatch.from_arrays(columns, ["word", "clean", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    sizes = {1: SAMPLE_TOXIC, 0: SAMPLE_CLEAN}
    rows = one_per_family(training_rows(docs, labels, label, sizes, doc_id, text)).persist()
    n = dict(rows.groupBy("y").count().collect())
    if len(n) < 2:
        rows.unpersist()
        return Model()
    counts = rows.select("y", "body").mapInArrow(_count_words, "word binary, clean long, toxic long")
    counts = counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = F.col("toxic") / n[1] / (F.col("toxic") / n[1] + F.col("clean") / n[0])
    alone = F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))
    least = int(np.ceil(np.log(CHANCE) / np.log(n[1] / (n[0] + n[1]))))
    terms = counts.where((F.col("toxic") >= least) & alone & (rate > 0.9))
    # All terms that pass, bounded by the words of the bounded sample.
    chosen = [bytes(r.word).decode("utf-8", "replace") for r in terms.orderBy(F.desc("toxic"), "word").collect()]
    model = Model(chosen)
    model.fuzzy = _trusted(rows, chosen, n)
    found = _sample_hits(rows, model)
    x = np.array([features(e, m) for _, e, m, _, _ in found])
    y = np.array([r[0] for r in found], float)
    model.weights = fit_logistic(x, y).tolist()
    rows.unpersist()
    return model


def _sample_hits(rows: DataFrame, model: Model) -> list:
    scored = annotate(rows, [F.col("body")], _hits(model), _HITS, "_h")
    return scored.select("y", "_h.exact", "_h.near", "_h.n_words", "_h.terms").collect()


def _trusted(rows: DataFrame, terms: list[str], n: dict[int, int]) -> set[str]:
    """Terms whose misspellings are no words of clean documents."""
    seen = {0: Counter(), 1: Counter()}
    for y, _, _, _, hit in _sample_hits(rows, Model(terms, set(terms))):
        seen[y].update(set(hit))
    return {t for t in terms if len(t) >= FUZZY_LENGTH and seen[0][t] <= 0.2 * seen[1][t] * n[0] / n[1] and seen[0][t] <= 0.0005 * n[0]}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic weights by Newton steps; both classes weigh the same."""
    w = np.zeros(x.shape[1])
    each = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    penalty = np.full(x.shape[1], ridge * len(y) / 1000)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (each * (p - y)) + penalty * w
        hessian = (x * (each * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- scoring ---------------------------------------------------------------------------

_HITS = "exact double, near double, n_words long, terms array<string>, score double"


def _hits(model: Model):
    state: dict = {}

    def batch(texts):
        if "known" not in state:
            state["known"] = Table(Lexicon(model.terms, model.fuzzy).lookup, KNOWN_WORDS)
        out = {"exact": [], "near": [], "n_words": [], "terms": [], "score": []}
        for text in as_bytes(texts):
            exact, near, n_words, terms = weighted_hits(text, state["known"])
            for name, value in zip(out, (exact, near, n_words, terms, model.score(exact, near)), strict=True):
                out[name].append(value)
        return out

    return batch


def scored(docs: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """Add the probability ``name`` that the text is toxic."""
    step = free_name(docs.columns, "_hits")
    return annotate(docs, [text_bytes(text)], _hits(model), _HITS, step).withColumn(name, F.col(step)["score"]).drop(step)


def predictions(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = learn(docs, labels, doc_id=doc_id, text=text)
    rows = scored(docs.select(doc_id, text), model, "_score", text)
    return rows.select(
        doc_id,
        held_out(F.col(doc_id)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7
) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    model = learn(docs, labels, doc_id=doc_id, text=text)
    name = free_name(docs.columns, "_score")
    kept = scored(docs, model, name, text).where(F.col(name) < threshold)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
