"""Quality of a text by a convolutional network on its bytes, in numpy.

Bytes are embedded, ``FILTERS`` learned filters of ``WIDTH`` bytes slide over overlapping
chunks that cover the whole document, each filter is max-pooled per chunk, and the pooled
values of all chunks (their mean and their maximum) enter one logistic unit.  At scoring,
embedding and filters are folded into one table per filter position, so a filter response
is a sum of table look-ups.

Learning is bounded: at most ``SAMPLE`` rows per label that may be learned from, chosen by
a hash, with ``TRAIN_CHUNKS`` chunks spread over each text; it takes ``EPOCHS`` passes of
gradient descent on the driver.  Scoring reads every byte.

Defined cases: null and empty texts are one chunk of padding; texts shorter than a filter
are padded; repeated rows get equal scores; without training rows of both labels every
score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import annotate, as_bytes, free_name, held_out, text_bytes
from vitalspan.llm.toxicity import training_rows

WIDTH, FILTERS, DIMENSIONS = 5, 12, 6
CHUNK, STEP = 512, 448
SAMPLE = 1500
TRAIN_CHUNKS = 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
PAD = 256


def chunk_starts(n: int) -> list[int]:
    """Starts of overlapping chunks of ``CHUNK`` bytes that cover ``n`` bytes."""
    return [0] if n <= CHUNK else [*range(0, n - CHUNK, STEP), n - CHUNK]


def as_codes(text: bytes) -> np.ndarray:
    codes = np.frombuffer(text, np.uint8).astype(np.int16)
    return np.concatenate([codes, np.full(WIDTH - len(codes), PAD, np.int16)]) if len(codes) < WIDTH else codes


@dataclass
class Network:
    tables: np.ndarray  # (WIDTH, PAD + 1, FILTERS): response of each filter position to each byte
    bias: np.ndarray
    weights: np.ndarray  # of the pooled means, then of the pooled maxima
    offset: float

    def pooled(self, text: bytes) -> np.ndarray:
        """Mean and maximum over chunks of the max-pooled filter responses."""
        codes = as_codes(text)
        n = len(codes)
        starts = np.array(chunk_starts(n))
        span = min(n, CHUNK) - WIDTH + 1
        per_chunk = np.empty((len(starts), len(self.bias)), np.float32)
        # A bounded part of the text at a time; every filter window of every chunk is seen.
        for a in range(0, len(starts), 64):
            own = starts[a : a + 64]
            low, high = own[0], own[-1] + span + WIDTH - 1
            part = codes[low:high]
            response = self.tables[0][part[: len(part) - WIDTH + 1]]
            for k in range(1, WIDTH):
                response = response + self.tables[k][part[k : len(part) - WIDTH + 1 + k]]
            for i, s in enumerate(own - low):
                per_chunk[a + i] = response[s : s + span].max(axis=0)
        per_chunk = np.maximum(per_chunk + self.bias, 0)
        return np.concatenate([per_chunk.mean(axis=0), per_chunk.max(axis=0)])

    def score(self, text: bytes) -> float:
        z = float(self.pooled(text) @ self.weights + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _windows(codes: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(codes, WIDTH, axis=-1)


def _training_chunks(texts: list[bytes]) -> np.ndarray:
    """(texts, TRAIN_CHUNKS, CHUNK) codes, the chunks spread evenly over each text."""
    out = np.full((len(texts), TRAIN_CHUNKS, CHUNK), PAD, np.int16)
    for i, text in enumerate(texts):
        codes = as_codes(text)
        starts = chunk_starts(len(codes))
        chosen = [starts[j * (len(starts) - 1) // max(1, TRAIN_CHUNKS - 1)] for j in range(TRAIN_CHUNKS)]
        for j, s in enumerate(chosen):
            piece = codes[s : s + CHUNK]
            out[i, j, : len(piece)] = piece
    return out


def _cut_out(text: bytes, rng: np.random.Generator) -> bytes:
    """A short passage of the text: short documents are rare, and learned from this way."""
    size = int(rng.integers(20, 160))
    low = int(rng.integers(0, max(1, len(text) - size)))
    low = text.find(b" ", low) + 1 if low else 0
    return text[low : low + size]


def train(texts: list[bytes], y: np.ndarray, seed: int = 5) -> Network:
    """Gradient descent with adaptive moments on the cross entropy, both classes weighing the same.

    Every text is learned from twice: by its chunks and by one short passage.
    """
    rng = np.random.default_rng(seed)
    chunks = np.concatenate([_training_chunks(texts), _training_chunks([_cut_out(t, rng) for t in texts])])
    y = np.concatenate([y, y])
    p = {
        "embed": rng.normal(0, 0.5, (PAD + 1, DIMENSIONS)),
        "filter": rng.normal(0, (WIDTH * DIMENSIONS) ** -0.5, (WIDTH * DIMENSIONS, FILTERS)),
        "bias": np.zeros(FILTERS),
        "weights": rng.normal(0, 0.1, 2 * FILTERS),
        "offset": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    each = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            rows = order[a : a + BATCH]
            gradient = _gradient(p, chunks[rows], y[rows], each[rows])
            step += 1
            for k, g in gradient.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    filters = p["filter"].reshape(WIDTH, DIMENSIONS, FILTERS)
    tables = np.stack([p["embed"] @ filters[k] for k in range(WIDTH)]).astype(np.float32)
    return Network(tables, p["bias"], p["weights"], float(p["offset"][0]))


def _gradient(p: dict, chunks: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict:
    n, c, _ = chunks.shape
    windows = _windows(chunks)  # n, c, places, WIDTH
    filters = p["filter"].reshape(WIDTH, DIMENSIONS, FILTERS)
    response = sum((p["embed"] @ filters[k])[windows[..., k]] for k in range(WIDTH))
    # Padding behind a text shorter than a chunk is not part of the text.
    real = windows[..., -1] != PAD
    real[..., 0] = True
    response[~real] = -1e9
    best = response.argmax(axis=2)  # n, c, FILTERS
    top = np.take_along_axis(response, best[:, :, None, :], 2)[:, :, 0, :]
    pooled = np.maximum(top + p["bias"], 0)
    mean, which = pooled.mean(axis=1), pooled.argmax(axis=1)
    most = np.take_along_axis(pooled, which[:, None, :], 1)[:, 0, :]
    joined = np.concatenate([mean, most], axis=1)
    z = joined @ p["weights"] + p["offset"][0]
    d = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
    d_joined = d[:, None] * p["weights"]
    d_pooled = np.repeat(d_joined[:, None, :FILTERS] / c, c, axis=1)
    rows, cols = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
    d_pooled[rows, which, cols] += d_joined[:, FILTERS:]
    d_pooled = d_pooled * (pooled > 0)
    # Only the best window of each filter and chunk gets a gradient.
    at = np.take_along_axis(windows, best[:, :, :, None], 2)  # n, c, FILTERS, WIDTH
    embedded = p["embed"][at].reshape(n, c, FILTERS, WIDTH * DIMENSIONS)
    d_filter = np.einsum("ncf,ncfk->kf", d_pooled, embedded)
    d_input = d_pooled[..., None] * p["filter"].T  # n, c, FILTERS, WIDTH * DIMENSIONS
    d_embed = np.zeros_like(p["embed"])
    np.add.at(d_embed, at.ravel(), d_input.reshape(-1, DIMENSIONS))
    return {
        "embed": d_embed,
        "filter": d_filter + 1e-4 * p["filter"],
        "bias": d_pooled.sum(axis=(0, 1)),
        "weights": joined.T @ d + 1e-4 * p["weights"],
        "offset": np.array([d.sum()], np.float32),
    }


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality"):
    """The network, or None without training rows of both labels."""
    rows = training_rows(docs, labels, label, {0: SAMPLE, 1: SAMPLE}, doc_id, text)
    # Bounded: at most SAMPLE rows per label, each cut to the chunks that training uses.
    pieces = rows.select("id", "y", "body").orderBy("id", "y")
    cut = annotate(pieces, [F.col("body")], lambda texts: {"cut": [_spread(t) for t in as_bytes(texts)]}, "cut binary", "_c")
    found = cut.select("y", "_c.cut").collect()
    y = np.array([r.y for r in found], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    return train([bytes(r.cut) for r in found], y)


def _spread(text: bytes) -> bytes:
    """The bytes of the training chunks, so that a long text does not travel whole."""
    starts = chunk_starts(len(text))
    chosen = sorted({starts[j * (len(starts) - 1) // max(1, TRAIN_CHUNKS - 1)] for j in range(TRAIN_CHUNKS)})
    return b"".join(text[s : s + STEP] for s in chosen) if len(text) > CHUNK * TRAIN_CHUNKS else text


def scored(docs: DataFrame, network: Network | None, name: str, text: str = "text") -> DataFrame:
    """Add the probability ``name`` that the text is of good quality."""

    def batch(texts):
        return {"score": [0.5 if network is None else network.score(t) for t in as_bytes(texts)]}

    step = free_name(docs.columns, "_network")
    return annotate(docs, [text_bytes(text)], batch, "score double", step).withColumn(name, F.col(step)["score"]).drop(step)


def predictions(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    network = learn(docs, labels, doc_id=doc_id, text=text)
    rows = scored(docs.select(doc_id, text), network, "_score", text)
    return rows.select(
        doc_id,
        held_out(F.col(doc_id)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"),
    )
