"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A hash rotates the vector by sign flips and Walsh-Hadamard transforms, three
times, and takes the signed coordinate of largest magnitude.  A table joins
several hashes into a bucket; a vector lives in one bucket of each table and
also visits the buckets of its next best coordinates (multiprobe).  Pairs that
meet are verified by cosine in double precision.

The number of hashes follows the number of vectors, so that buckets stay small;
the number of tables follows from the chance, measured on random pairs at the
threshold, that such a pair meets in one table.

Pairs are never rows.  A bucket is split into cells of bounded size; a cell
multiplies its block of vectors, counts each link in the first table and bucket
where its two ends meet (both know all their buckets), and emits counts for each
vector and a spanning set of links.  Equal vectors are one class beforehand.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.operators.components import connected_components
from vigilspark.storage import materialize

PROBES = 3
CELL = 2_000
#: More tables than this are an error rather than a silently higher miss rate.
MOST_TABLES = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def bucket_codes(x: np.ndarray, tables: int, hashes: int, probes: int = PROBES) -> np.ndarray:
    """[rows, tables, 1 + probes] bucket numbers: home first, then the probes by loss of magnitude."""
    n, given = x.shape
    d = 1 << max(1, (given - 1).bit_length())
    padded = np.zeros((n, d))
    padded[:, :given] = x
    signs = np.random.default_rng(20_170 + d)
    out = np.empty((n, tables, 1 + probes), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, loss, other = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * signs.choice((-1.0, 1.0), d))
            size = np.abs(y)
            ranks = min(d, 1 + probes)
            top = np.argpartition(-size, ranks - 1, axis=1)[:, :ranks]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            value = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            height = np.take_along_axis(size, top, 1)
            best.append(value[:, 0])
            other.append(value[:, 1:])
            loss.append(height[:, :1] - height[:, 1:])
        home = np.zeros(n, np.int64)
        for b in best:
            home = home * (2 * d) + b
        out[:, t, 0] = home
        changed = []
        for k in range(hashes):
            step = (2 * d) ** (hashes - 1 - k)
            changed.append(home[:, None] + (other[k] - best[k][:, None]) * step)
        changed, loss = np.concatenate(changed, axis=1), np.concatenate(loss, axis=1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(changed, order, 1)
        out[:, t, 1:] = home[:, None]
        out[rows[:, None], t, 1 + np.arange(found.shape[1])[None, :]] = found
    return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[pairs, tables]: whether one's home is home or probe of the other."""
    return (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)


def plan(n: int, dims: int, threshold: float, miss: float) -> tuple[int, int]:
    """(tables, hashes) for ``n`` vectors, so that a pair at the threshold is missed with chance ``miss``."""
    d = 1 << max(1, (dims - 1).bit_length())
    hashes = max(1, math.ceil(math.log(max(n, 2)) / math.log(2 * d)))
    rng = np.random.default_rng(7)
    a = rng.standard_normal((2_000, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2_000, dims))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold * threshold)) * b
    p = float(meets(bucket_codes(a, 3, hashes), bucket_codes(b, 3, hashes)).mean())
    tables = max(2, math.ceil(math.log(miss) / math.log(1 - min(p, 0.999)))) if p > 0 else MOST_TABLES + 1
    if tables > MOST_TABLES:
        raise ValueError(f"a miss rate of {miss} at cosine {threshold} needs {tables} tables; allow more misses or a higher threshold")
    return tables, hashes


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether (table, code) is the first bucket where each pair meets; ``a`` has the smaller id."""
    count = np.ones(len(a), bool)
    for t in range(table):
        one, two = a[:, t], b[:, t]
        count &= ~((one[:, :1] == two).any(axis=1) | (two[:, :1] == one).any(axis=1))
    one, two = a[:, table], b[:, table]
    at_first = (two == one[:, :1]).any(axis=1)
    return count & (np.where(at_first, one[:, 0], two[:, 0]) == code)


def _spanning(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` nodes."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, u, low[v])
        np.minimum.at(new, v, low[u])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    miss: float = 1e-4,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each row of ``vectors``.

    Vectors are compared if their labels are equal and not null and their lengths
    are equal.  Vectors that are null, empty, zero or hold null or non-finite
    components, and those with a null id, link with nothing and are kept as their
    own component.  Rows that repeat an id are vectors of their own.  Other
    columns are not read.  No pair below ``threshold`` is linked; a pair at the
    threshold is missed with a chance of about ``miss``, closer pairs with less.
    """
    spark = vectors.sparkSession
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")
    )

    def classes_of(batches):
        for batch in batches:
            ids, labels, found = batch.column(0), batch.column(2), []
            for i, v, label in zip(ids.to_pylist(), batch.column(1).to_pylist(), labels.to_pylist(), strict=True):
                x = None
                if i is not None and label is not None and v and None not in v:
                    x = np.array(v, np.float64)
                    scale = np.abs(x).max()
                    if not np.isfinite(scale) or scale == 0:
                        x = None
                    else:  # scaled by a power of two: exact, and no square overflows
                        x = np.ldexp(x, -int(np.frexp(scale)[1])) + 0.0
                found.append(None if x is None else x.tobytes())
            digest = [None if f is None else xxhash.xxh3_128_digest(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array(digest, pa.binary()), pa.array(found, pa.binary())], ["id", "label", "digest", "x"]
            )

    rows = materialize(plain.mapInArrow(classes_of, "id long, label string, digest binary, x binary"), "vectors")
    classes = rows.where("x is not null").groupBy("label", "digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("times"), F.first("x").alias("x")
    )
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count("*"), F.max(F.octet_length("x"))).first()
    tables, hashes = plan(facts[0], max(1, (facts[1] or 8) // 8), threshold, miss)

    def place(batches):
        for batch in batches:
            cls, data = batch.column(0), batch.column(1).to_pylist()
            codes: list[bytes | None] = [None] * len(data)
            for size in {len(x) for x in data}:
                at = [k for k, x in enumerate(data) if len(x) == size]
                x = np.stack([np.frombuffer(data[k], np.float64) for k in at])
                for k, c in zip(at, bucket_codes(x, tables, hashes), strict=True):
                    codes[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([cls, pa.array(codes, pa.binary())], ["class", "codes"])

    placed = materialize(classes.select("class", "x").mapInArrow(place, "class long, codes binary"), "placed")

    def enter(batches):
        """A row for each vector and bucket that it lives in or visits."""
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([np.frombuffer(c, np.int64).reshape(tables, 1 + PROBES) for c in batch.column(3).to_pylist()])
            new = np.ones(codes.shape, bool)
            for k in range(1, 1 + PROBES):
                new[:, :, k] = ~(codes[:, :, k : k + 1] == codes[:, :, :k]).any(axis=2)
            row, table, k = np.nonzero(new)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table.astype(np.int32)), batch.column(1).take(taken), batch.column(2).take(taken),
                    pa.array(codes[row, table, k]), pa.array(k == 0), batch.column(0).take(taken),
                ],
                ["tbl", "label", "dims", "code", "home", "class"],
            )

    key = ["tbl", "label", "dims", "code"]
    described = classes.select("class", "label", F.octet_length("x").cast("int").alias("dims"))
    entries = materialize(
        placed.join(described, "class").select("class", "label", "dims", "codes").mapInArrow(
            enter, "tbl int, label string, dims int, code long, home boolean, class long"
        ),
        "entries",
    )
    # buckets with a resident and somebody else; the others hold no pair
    shared = entries.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    shared = materialize(shared.withColumn("parts", F.ceil(F.col("n") / F.lit(CELL)).cast("int")).drop("n", "homes"), "buckets")
    own_part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    members = entries.join(shared, key).select(*key, "class", "home", "parts", own_part.alias("part"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = members.select(*key, "class", "home", "part", F.least("part", "other").alias("ca"), F.greatest("part", "other").alias("cb"))
    loaded = cells.join(classes.join(placed, "class").select("class", "times", "x", "codes"), "class")
    cell_key = [*key, "ca", "cb"]
    loaded = loaded.repartition(*cell_key).sortWithinPartitions(*cell_key)
    loaded = loaded.select(*cell_key, "class", "part", "times", "x", "codes", "home")

    def verify(batches):
        def rows_of():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for (table, _, _, code, ca, cb), group in groupby(rows_of(), key=lambda r: r[:6]):
            group = list({r[6]: r for r in group}.values())
            cls = np.array([r[6] for r in group])
            order = np.argsort(cls)
            group, cls = [group[k] for k in order], cls[order]
            part = np.array([r[7] for r in group])
            times = np.array([r[8] for r in group], np.int64)
            x = np.stack([np.frombuffer(r[9], np.float64) for r in group])
            codes = np.stack([np.frombuffer(r[10], np.int64).reshape(tables, 1 + PROBES) for r in group])
            home = np.array([r[11] for r in group])
            norm = np.sqrt((x * x).sum(axis=1))
            cosine = (x @ x.T) / (norm[:, None] * norm[None, :])
            # two that only visit the bucket do not meet here, as the count of first meetings has it
            close = np.triu(cosine >= threshold, 1) & (home[:, None] | home[None, :])
            if ca != cb:
                close &= part[:, None] != part[None, :]
            u, v = np.nonzero(close)
            first = _first_meeting(codes[u], codes[v], table, code)
            n = np.bincount(u[first], weights=times[v[first]], minlength=len(cls)) + np.bincount(v[first], weights=times[u[first]], minlength=len(cls))
            root = _spanning(len(cls), u, v)
            some = np.flatnonzero((n > 0) | (root != np.arange(len(cls))))
            if some.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[some]), pa.array(cls[root[some]]), pa.array(n[some].astype(np.int64))], ["class", "root", "links"]
                )

    found = materialize(loaded.mapInArrow(verify, "class long, root long, links long"), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    components = connected_components(found.select("class", "root"), "class", "root")
    marked = classes.select("class", "label", "digest", "rep", "times").join(links, "class", "left").join(
        components.withColumnRenamed("node", "class"), "class", "left"
    )
    marked = marked.select(
        "label", "digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "class").alias("component")
    )
    low = marked.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = marked.join(low, "component").select("label", "digest", "n_links", "component_id")
    out = rows.join(by_class, ["label", "digest"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id").eqNullSafe(component)).alias("kept"),
    )
