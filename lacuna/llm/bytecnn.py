"""Quality classifier: a convolutional network over the bytes of whole texts, in numpy.

Bytes are embedded; filters of WIDTH bytes move by STRIDE over the whole text; the windows are covered by
overlapping chunks; a filter's response in a chunk is its maximum there. The mean, the largest and the smallest chunk
response of every filter go through one hidden layer to one probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lacuna.llm.labelled import fit_on_labelled, fold
from lacuna.llm.texts import by_text

EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 4, 8, 4, 32, 16

#: Windows of a chunk and from one chunk to the next: about 130 bytes, a quarter of them shared. In so
#: short a chunk a repeated word meets few filters, and the smallest chunk response shows it.
CHUNK, HOP = 32, 24

#: Bytes embedded at once when scoring; longer texts are convolved part by part.
SPAN = 1 << 20


def chunked(values: np.ndarray) -> np.ndarray:
    """The windows' values by chunk, window and filter; the last chunk is filled up with values no maximum takes."""
    chunks = max(1, -(-(len(values) - CHUNK) // HOP) + 1)
    whole = np.full(((chunks - 1) * HOP + CHUNK, values.shape[1]), -1e9, np.float32)
    whole[: len(values)] = values
    row, step = whole.strides
    return np.lib.stride_tricks.as_strided(whole, (chunks, CHUNK, values.shape[1]), (HOP * row, row, step))


def padded(text: str) -> np.ndarray:
    """The text's bytes, with zeros up to a whole number of windows; the empty text is one window of zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    windows = max(1, -(-(len(raw) - WIDTH) // STRIDE) + 1)
    out = np.zeros((windows - 1) * STRIDE + WIDTH, np.uint8)
    out[: len(raw)] = raw
    return out


class ByteNet:
    def __init__(self, seed: int = 0):
        draw = np.random.default_rng(seed)
        def normal(rows, columns, scale):
            return (draw.standard_normal((rows, columns)) * scale).astype(np.float32)
        self.weights = {"embed": normal(256, EMBED, 0.5), "filters": normal(WIDTH * EMBED, FILTERS, 0.3), "shift": np.zeros((1, FILTERS), np.float32),
                        "hidden": normal(3 * FILTERS, HIDDEN, 0.1), "bias": np.zeros((1, HIDDEN), np.float32),
                        "out": normal(HIDDEN, 1, 0.2), "prior": np.zeros((1, 1), np.float32)}

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Every window's embedded bytes as one row, a view on the embedded text."""
        rows = self.weights["embed"][data].ravel()
        step = rows.itemsize
        return np.lib.stride_tricks.as_strided(rows, ((len(data) - WIDTH) // STRIDE + 1, WIDTH * EMBED), (STRIDE * EMBED * step, step))

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Chunk responses of one text, chunk by filter. Parts of SPAN bytes start at chunk borders."""
        windows = (len(data) - WIDTH) // STRIDE + 1
        hop = HOP * max(1, SPAN // (HOP * STRIDE))
        found = []
        for first in range(0, max(windows - (CHUNK - HOP), 1), hop):
            end = min(first + hop + CHUNK - HOP, windows)
            values = self.windows(data[first * STRIDE : (end - 1) * STRIDE + WIDTH]) @ self.weights["filters"]
            found.append(chunked(values).max(axis=1))
        return np.maximum(np.concatenate(found) + self.weights["shift"], 0)

    def features(self, text: str) -> np.ndarray:
        chunks = self.responses(padded(text))
        return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0), chunks.min(axis=0)])

    def head(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights
        hidden = np.maximum(features @ w["hidden"] + w["bias"], 0)
        return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["prior"], -30, 30)))[:, 0]

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.head(np.stack([self.features(t) for t in texts]))[1].astype(float)

    def gradients(self, batch: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. A maximum passes its gradient to the window that holds it."""
        w, picked, pooled, owner = self.weights, [], [], []
        for i, data in enumerate(batch):
            values = self.windows(data) @ w["filters"]
            parts = chunked(values)
            best = parts.argmax(axis=1)
            picked.append((best + np.arange(len(parts))[:, None] * HOP) * STRIDE)
            pooled.append(np.take_along_axis(parts, best[:, None], axis=1)[:, 0])
            owner += [i] * len(parts)
        at, owner = np.concatenate(picked), np.array(owner)
        raw = np.concatenate(pooled) + w["shift"]
        chunks = np.maximum(raw, 0)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        counts = np.diff(np.append(starts, len(owner)))[:, None]
        means = np.add.reduceat(chunks, starts) / counts
        high, low = np.maximum.reduceat(chunks, starts), np.minimum.reduceat(chunks, starts)
        features = np.concatenate([means, high, low], axis=1)
        hidden, p = self.head(features)
        error = ((p - labels) / len(labels)).astype(np.float32)[:, None]
        back = (error @ w["out"].T) * (hidden > 0)
        into = back @ w["hidden"].T
        d_mean, d_high, d_low = np.split(into, 3, axis=1)
        d = (d_mean / counts)[owner] + d_high[owner] * (chunks == high[owner]) + d_low[owner] * (chunks == low[owner])
        d *= raw > 0
        data = np.concatenate(batch)
        offset = np.concatenate([[0], np.cumsum([len(b) for b in batch])[:-1]])[owner]
        bytes_ = data[(at + offset[:, None])[:, :, None] + np.arange(WIDTH)]  # chunk, filter, place
        seen = w["embed"][bytes_].reshape(*at.shape, -1)
        spread = (d[:, :, None] * w["filters"].T[None]).reshape(-1, EMBED)
        embed = np.stack([np.bincount(bytes_.ravel(), spread[:, e], 256) for e in range(EMBED)], axis=1)
        return {"embed": embed, "filters": np.einsum("cf,cfi->if", d, seen), "shift": d.sum(axis=0, keepdims=True),
                "hidden": features.T @ back, "bias": back.sum(axis=0, keepdims=True), "out": hidden.T @ error, "prior": error.sum(keepdims=True)}


def fit(examples: list[tuple[str, int]], steps: int = 600, batch: int = 32, rate: float = 4e-3, seed: int = 0) -> ByteNet:
    """Adam with a falling rate over keyed random batches. With no labels or one class the prior alone answers."""
    net, draw = ByteNet(seed), np.random.default_rng(seed + 1)
    labels = np.array([y for _, y in examples], np.float32)
    share = (labels.sum() + 1) / (len(labels) + 2)
    net.weights["prior"][:] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        net.weights["out"][:] = 0
        return net
    data = [padded(t) for t, _ in examples]
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, draw.permutation(len(data))])
        now, order = order[:batch], order[batch:]
        pace = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
        for k, g in net.gradients([data[i] for i in now], labels[now]).items():
            g = g.astype(np.float32) + 1e-4 * net.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.weights[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000, most_bytes: int = 32_000_000,
           key: str = "doc_id", text: str = "text") -> ByteNet:
    """The network fitted in one task on at most ``rows`` labelled texts of ``most_bytes`` bytes in all, outside the held-out fold."""
    net = ByteNet()
    net.weights = fit_on_labelled(docs, labels, label, rows, most_bytes, lambda examples: fit(examples).weights, key, text)
    return net


def with_score(df: DataFrame, net: ByteNet, out: str, text: str = "text") -> DataFrame:
    """All columns of every row and the score (0 to 1) of its text; null and empty texts are scored as one window of zeros."""
    def make():
        return lambda texts: {out: net.score(texts)}

    return by_text(df, df.columns, text, make, f"{out} double")


def quality(df: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` of every row, by a network fitted on the labels.

    Labels are used for the fit alone. Rows are independent: repeated rows get the same score, null keys are not
    held out, other columns are left out. Without labels, or with labels of one class, every score is the
    smoothed share of label 1; an empty table gives no rows.
    """
    net = fit_on(df, labels, label, key=key, text=text)
    answers = with_score(df.select(F.col(key), F.col(text).alias("text")), net, "score").drop("text")
    return answers.select(key, (F.coalesce(fold(F.col(key)), F.lit(-1)) == 0).alias("held_out"), "score",
                          (F.col("score") >= threshold).cast("int").alias("predicted"))
