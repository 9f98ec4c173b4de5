import numpy as np

from tests.llm.helpers import rows_of
from vigilspark.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, component string, x string, id int"


def brute(rows, threshold=0.98):
    def usable(v, label, i):
        return i is not None and label is not None and v and None not in v and np.isfinite(np.float32(v)).all() and any(v)

    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (i, v, x, *_) in enumerate(rows):
        for b, (j, w, y, *_) in enumerate(rows[:a]):
            if x == y and usable(v, x, i) and usable(w, y, j) and len(v) == len(w):
                p, q = np.float32(v).astype(np.float64), np.float32(w).astype(np.float64)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    parent[root(a)] = root(b)
    low = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    out = [(i, n[k], low.get(root(k)), i == low.get(root(k))) for k, (i, *_) in enumerate(rows)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def make(spark, rows):
    return spark.createDataFrame([(i, v, x, "z", "z", 1) for i, v, x in rows], SCHEMA)


def random_rows(seed=0, groups=12, size=8, dims=24):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(size):
            noise = rng.standard_normal(dims) * rng.choice([0.03, 0.1, 0.15])
            rows.append((i, (centre + noise).astype(np.float32).tolist(), int(g % 3)))
            i += 1
    rows += [(i, None, 0), (i + 1, [], 0), (i + 2, [0.0] * dims, 0), (i + 3, [float("nan")] + [1.0] * (dims - 1), 0), (i + 4, [None] + [1.0] * (dims - 1), 0)]
    rows += [(i + 5, rows[0][1], None), (i + 6, rows[0][1], 0), (i + 7, rows[0][1], 0), (i + 8, [1.0, 2.0], 0), (i + 9, [1.0, 2.0], 0), (None, rows[0][1], 0), (i + 10, [float("inf")] * dims, 0)]
    return rows


def test_equals_brute_force(spark):
    rows = random_rows()
    got = rows_of(V.near_duplicate_vectors(make(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    want = [(i, n, c if c is not None else None, bool(k) or i is None) for i, n, c, k in brute(rows)]
    assert got == want
    assert V.near_duplicate_vectors(make(spark, [])).count() == 0


def test_large_bucket_in_cells(spark, monkeypatch):
    """A group larger than a cell: links of different cells are counted once."""
    monkeypatch.setattr(V, "CELL", 16)
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(90)]
    got = rows_of(V.near_duplicate_vectors(make(spark, rows)), "vec_id", "n_links", "component_id", "kept")
    assert got == brute(rows)


def test_recall_at_the_threshold():
    """Pairs exactly at the threshold meet in at least one table nearly always."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b
    tables, hashes = V.plan(50_000, 64, 0.98, 1e-4)
    assert V.meets(V.bucket_codes(a, tables, hashes), V.bucket_codes(b, tables, hashes)).any(axis=1).mean() > 0.999


def test_hadamard():
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(V.hadamard(V.hadamard(x)), x) and np.allclose(np.linalg.norm(V.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
