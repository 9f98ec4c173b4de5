"""Quality classifier: logistic regression on hashed word n-grams, learned by FTRL-proximal.

Tokens are words in lower case and runs of symbols; a token equal to the one
before it is the token ``=``, so that stuttering shows in any vocabulary.
Unigrams and bigrams are hashed into one table of weights; a text's features are
its n-gram frequencies divided by their Euclidean norm.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.bpe import Memo
from vigilspark.llm.common import by_row, doc_text, held, small_batches

TOKENS = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 20


def _hashes() -> Memo:
    return held("quality words", lambda: Memo(lambda token: xxhash.xxh64_intdigest(token.lower().encode())))


_SAME = np.uint64(xxhash.xxh64_intdigest(b"="))


def features(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers of a text and their values; feature 0 is the constant 1."""
    tokens = TOKENS.findall(text) if text else []
    h = np.fromiter(map(_hashes().__getitem__, tokens), np.uint64, len(tokens))
    h[1:][h[1:] == h[:-1]] = _SAME
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> np.uint64(31)
    every = np.concatenate((h, pairs)) % np.uint64(buckets - 1) + np.uint64(1)
    index, n = np.unique(every.astype(np.int64), return_counts=True)
    norm = float(np.sqrt((n.astype(np.float64) ** 2).sum())) or 1.0
    return np.concatenate(([0], index)), np.concatenate(([1.0], n / norm))


class Ftrl:
    """FTRL-proximal for the logistic loss, sparse updates."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, index: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(index)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[index]
        grown = n + g * g
        self.z[index] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[index] = grown


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "quality",
    sample_docs: int = 12_000,
    epochs: int = 4,
    buckets: int = BUCKETS,
) -> np.ndarray:
    """Weights learned from at most about ``sample_docs`` labelled rows, chosen by the hash of their text.

    Rows of one text and label teach once, so that neither null or repeated ids nor
    copies can flood the sample; ids are not read.

    FTRL is sequential: one task takes the bounded sample in hash order,
    ``epochs`` times.  The bound is on fitting alone; whole texts are used.  Rows
    with a null label teach nothing; without any row all weights are 0 and every
    score is 0.5.
    """
    rows = small_batches(labelled).select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("double").alias("y"))
    rows = rows.where("y is not null")
    total = rows.count()
    part = 1_000_000 if total <= sample_docs else max(1, 1_000_000 * sample_docs // total)
    order = F.xxhash64("text", F.lit("fit"))
    sample = rows.where(F.pmod(order, F.lit(1_000_000)) < part).select("text", "y").distinct().select(order.alias("o"), "text", "y")

    def learn(batches):
        kept = []
        for batch in batches:
            for o, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                index, value = features(text, buckets)
                kept.append((o, index.astype(np.int32), value.astype(np.float32), y))
        kept.sort(key=lambda r: (r[0], r[3]))
        model = Ftrl(buckets)
        for _ in range(epochs):
            for _, index, value, y in kept:
                model.learn(index, value, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], ["w"])

    found = sample.repartition(1).mapInArrow(learn, "w binary").first()
    return np.frombuffer(bytes(found["w"]), np.float32) if found else np.zeros(buckets, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)``, a row for each row of ``docs``: the sparse dot product through the logistic function.

    Null and empty texts have the constant feature alone.  Null ids and repeated
    rows are kept; other columns are not read.  The weights have a fixed size
    (4 MB for 2^20 buckets) and are broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32).tobytes())
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    buckets = len(weights)

    def rows(source):
        w = np.frombuffer(shipped.value, np.float32)
        for i, text in source:
            index, value = features(text, buckets)
            dot = float(w[index].astype(np.float64) @ value)
            yield 1, i, 1.0 / (1.0 + float(np.exp(-min(35.0, max(-35.0, dot)))))

    return doc_text(docs, id_col, text_col).mapInArrow(by_row(schema, rows), "doc_id long, score double")
