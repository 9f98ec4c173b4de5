"""Similarity model of channel fingerprints (UD-2, UD-3, UD-8).

The encoder is a small network given as weight matrices; scoring is a batched
matrix product.  :func:`fit_contrastive` learns the weights: each step sums the
gradients of a mini-batch on the executors, in levels of fixed fan-in, and Adam moves
the weights.  :func:`fit_native` is a logistic regression on absolute differences.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilspark.storage import materialize

Layers = list[tuple[np.ndarray, np.ndarray]]


def encode(x: np.ndarray, layers: Layers) -> np.ndarray:
    """Linear layers with ReLU between them."""
    for k, (w, b) in enumerate(layers):
        x = x @ w.T + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    return x


def similarity(pairs: DataFrame, layers: Layers, a: str = "vector_a", b: str = "vector_b") -> DataFrame:
    """``pairs`` with the column ``similarity``: cosine of the two encodings, mapped to 0..1."""

    @F.pandas_udf(T.DoubleType())
    def score(left: pd.Series, right: pd.Series) -> pd.Series:
        if not len(left):
            return pd.Series([], dtype="float64")
        x, y = (encode(np.stack(s.to_numpy()).astype(np.float64), layers) for s in (left, right))
        size = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        return pd.Series((np.where(size > 0, (x * y).sum(axis=1) / np.where(size > 0, size, 1), 0.0) + 1) / 2)

    return pairs.withColumn("similarity", score(a, b))


def start_layers(sizes: tuple[int, ...], seed: int) -> Layers:
    rng = np.random.default_rng(seed)
    return [(rng.standard_normal((o, i)) * np.sqrt(2 / i), np.zeros(o)) for i, o in zip(sizes, sizes[1:], strict=False)]


def gradient(x: np.ndarray, y: np.ndarray, label: np.ndarray, layers: Layers, margin: float) -> tuple[float, Layers]:
    """Sum of the contrastive losses of pairs and its gradient.

    With similarity s = (cosine + 1) / 2 of the encodings a pair costs (1 - s)^2 if it
    is one operator's, else max(0, margin - (1 - s))^2.
    """

    def forward(v: np.ndarray) -> list[np.ndarray]:
        held = [v]
        for k, (w, b) in enumerate(layers):
            v = v @ w.T + b
            v = np.maximum(v, 0) if k < len(layers) - 1 else v
            held.append(v)
        return held

    left, right = forward(x), forward(y)
    a, b = left[-1], right[-1]
    na, nb = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (a, b))
    cosine = (a * b).sum(axis=1, keepdims=True) / (na * nb)
    s, t = (cosine[:, 0] + 1) / 2, label.astype(np.float64)
    close = np.maximum(margin - 1 + s, 0)
    loss = float((t * (1 - s) ** 2 + (1 - t) * close**2).sum())
    slope = ((-2 * t * (1 - s) + 2 * (1 - t) * close) / 2)[:, None]
    out = [(np.zeros_like(w), np.zeros_like(c)) for w, c in layers]
    for held, d in ((left, slope * (b / (na * nb) - cosine * a / na**2)), (right, slope * (a / (na * nb) - cosine * b / nb**2))):
        for k in range(len(layers) - 1, -1, -1):
            out[k][0][...] += d.T @ held[k]
            out[k][1][...] += d.sum(axis=0)
            d = (d @ layers[k][0]) * (held[k] > 0) if k else d
    return loss, out


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([p.ravel() for pair in layers for p in pair])


def _shaped(flat: np.ndarray, like: Layers) -> Layers:
    out, at = [], 0
    for w, b in like:
        out.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
        at += w.size + b.size
    return out


def _summed(parts: DataFrame, n: int, fan: int = 32) -> np.ndarray:
    """The sum of the float64 vectors in the binary column ``g`` of ``n`` partitions, in levels of ``fan``."""

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                v = np.frombuffer(v, np.float64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(add, "g binary")
    return sum(np.frombuffer(bytes(r["g"]), np.float64) for r in parts.collect())


def fit_contrastive(
    pairs: DataFrame, a: str = "vector_a", b: str = "vector_b", label: str = "label", sizes: tuple[int, ...] = (28, 64, 32, 16),
    margin: float = 0.5, epochs: int = 30, batches: int = 4, rate: float = 3e-3, seed: int = 7,
) -> Layers:
    """Weights of an encoder learned from labelled pairs, all of them in every epoch.

    ``pairs`` are dealt to ``batches`` by hash and written once; a step is one job that
    sends the weights out and brings back one vector of their size for at most 32 partitions.
    Rows with a null vector or label, or another dimension, teach nothing.  Without
    rows the start weights come back.
    """
    layers = start_layers(sizes, seed)
    plain = pairs.select(F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"), F.col(label).cast("int").alias("label"))
    plain = plain.where(f"label is not null and size(a) = {sizes[0]} and size(b) = {sizes[0]}")
    dealt = materialize(plain.withColumn("batch", F.pmod(F.xxhash64("a", "b", F.lit(seed)), F.lit(batches))), "dealt")
    counts = {r["batch"]: r["count"] for r in dealt.groupBy("batch").count().collect()}
    flat = _flat(layers)
    mean, square, t = np.zeros_like(flat), np.zeros_like(flat), 0
    width = dealt.rdd.getNumPartitions()
    for _ in range(epochs):
        for batch, n in sorted(counts.items()):
            now = _shaped(flat, layers)

            def part(source, now=now):
                total = np.zeros(sum(w.size + c.size for w, c in now))
                for rows in source:
                    x, y = (np.array(rows.column(k).to_pylist(), np.float64) for k in (0, 1))
                    if len(x):
                        total += _flat(gradient(x, y, rows.column(2).to_numpy(), now, margin)[1])
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

            g = _summed(dealt.where(F.col("batch") == batch).select("a", "b", "label").mapInArrow(part, "g binary"), width) / n
            t += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            flat = flat - rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return _shaped(flat, layers)


def fit_native(pairs: DataFrame, a: str = "vector_a", b: str = "vector_b", label: str = "label"):
    """A logistic regression on absolute differences, trained on the executors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = pairs.select(array_to_vector(F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=50, regParam=0.01).fit(rows)


def augment(pairs: DataFrame, copies: int, sigma: float = 0.03, seed: int = 7, a: str = "vector_a", b: str = "vector_b") -> DataFrame:
    """Noisy copies of pairs: Gaussian noise on every component, the same in every run."""

    def noisy(column: str, side: int):
        def uniform(x, i, k: int):
            return (F.pmod(F.xxhash64(x, i, F.col("_copy"), F.lit(seed + 2 * side + k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)

        def shifted(x, i):
            return x + sigma * F.sqrt(-2 * F.log(uniform(x, i, 0))) * F.cos(2 * math.pi * uniform(x, i, 1))

        return F.transform(column, shifted)

    more = pairs.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    return more.withColumns({a: noisy(a, 0), b: noisy(b, 1)}).drop("_copy")
