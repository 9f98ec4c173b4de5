"""Contrastive training: gradients against differences, held-out ranking against the raw cosine."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.operators import siamese as N

SCHEMA = "vector_a array<double>, vector_b array<double>, label int"


def loss(x, y, t, layers):
    a, b = N.encode(x, layers), N.encode(y, layers)
    s = ((a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) + 1) / 2
    return (t * (1 - s) ** 2 + (1 - t) * np.maximum(0.5 - (1 - s), 0) ** 2).sum()


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    layers = N.start_layers((6, 5, 4), 3)
    x, y, t = rng.standard_normal((9, 6)), rng.standard_normal((9, 6)), rng.integers(0, 2, 9)
    got, slopes = N.gradient(x, y, t, layers, 0.5)
    assert got == pytest.approx(loss(x, y, t, layers))
    for k in range(2):
        for p in range(2):
            for at in list(np.ndindex(layers[k][p].shape))[::3]:
                ends = []
                for d in (1e-6, -1e-6):
                    moved = [tuple(m.copy() for m in pair) for pair in layers]
                    moved[k][p][at] += d
                    ends.append(loss(x, y, t, moved))
                assert slopes[k][p][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def rows(seed, n):
    """Operators differ in two components; the others are loud noise."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        who = rng.integers(0, 4, 2) if rng.random() < 0.5 else [rng.integers(0, 4)] * 2
        v = [np.concatenate(([[3.0, 0], [0, 3.0], [-3.0, 0], [0, -3.0]][w] + 0.3 * rng.standard_normal(2), 3 * rng.standard_normal(4))) for w in who]
        out.append((v[0].tolist(), v[1].tolist(), int(who[0] == who[1])))
    return out


def auc(scores, labels):
    good, bad = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_training_beats_the_raw_cosine(spark):
    train = spark.createDataFrame([*rows(1, 500), (None, [0.0] * 6, 1), ([1.0], [2.0], 0)], SCHEMA).repartition(3)
    held = rows(2, 300)
    layers = N.fit_contrastive(train, sizes=(6, 32, 8), epochs=12, batches=2, rate=0.02)
    table = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(held)], "i int, vector_a array<double>, vector_b array<double>")
    got = [r["similarity"] for r in N.similarity(table, layers).orderBy("i").collect()]
    raw = [np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) for a, b, _ in held]
    labels = [y for *_, y in held]
    assert auc(got, labels) > auc(raw, labels) + 0.05 and auc(got, labels) > 0.8


def test_no_rows_and_levels_of_sums(spark):
    none = N.fit_contrastive(spark.createDataFrame([], SCHEMA), sizes=(3, 2))
    assert all(np.array_equal(p, q) for a, b in zip(none, N.start_layers((3, 2), 7)) for p, q in zip(a, b))
    parts = spark.range(0, 50, 1, 50).select(F.lit(np.array([1.0, 2.0]).tobytes()).alias("g"))
    assert N._summed(parts, 50, fan=4).tolist() == [50.0, 100.0]
