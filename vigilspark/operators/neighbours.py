"""Exact nearest vectors of many queries (JN-13): tiles of query blocks and vector blocks, merged by a small top-k."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Numbers of all queries that a task holds, and of a product of queries and vectors at a time.
BLOCK_NUMBERS, PRODUCT = 4_000_000, 2_000_000


class Best:
    """The ``k`` best vectors so far of a block of queries of one dimension, by rounded similarity, then id."""

    def __init__(self, ids: list[int], vectors: list, k: int) -> None:
        self.k, self.ids, self.q = k, np.array(ids, np.int64), np.array(vectors, np.float64)
        norm = np.linalg.norm(self.q, axis=1, keepdims=True)
        self.q = np.divide(self.q, norm, out=np.zeros_like(self.q), where=norm > 0)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows of ``x`` with a norm above zero join the candidates."""
        norm = np.linalg.norm(x, axis=1)
        ids, x = ids[norm > 0], x[norm > 0] / norm[norm > 0, None]
        step = max(1, PRODUCT // max(1, len(ids)))
        for a in range(0, len(self.ids), step) if len(ids) else ():
            part = slice(a, a + step)
            s = np.round(self.q[part] @ x.T, 6)
            s[self.ids[part, None] == ids[None, :]] = -np.inf
            # only queries with a candidate at or above their worst one are sorted again
            some = np.flatnonzero(s.max(axis=1) >= self.score[part, -1])
            if not some.size:
                continue
            rows = a + some
            score = np.concatenate((self.score[rows], s[some]), axis=1)
            found = np.concatenate((self.found[rows], np.broadcast_to(ids, (some.size, ids.size))), axis=1)
            top = np.lexsort((found, -score), axis=1)[:, : self.k]
            self.score[rows], self.found[rows] = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)

    def rows(self, threshold: float) -> pa.RecordBatch:
        a, b = np.nonzero(self.score >= threshold)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.found[a, b]), pa.array(self.score[a, b])], ["query_id", "vec_id", "similarity"])


def _vectors(ids: list[int], vectors: list) -> Iterator[tuple[int, list[int], list]]:
    """(dimension, ids, vectors) of equal dimension; null and empty vectors and null components are left out."""
    kept = sorted(((len(v), i, v) for i, v in zip(ids, vectors, strict=True) if v and None not in v), key=lambda r: r[0])
    for n, rows in groupby(kept, key=lambda r: r[0]):
        rows = list(rows)
        yield n, [i for _, i, _ in rows], [v for *_, v in rows]


def _tile(k: int, threshold: float):
    """``mapInArrow`` over sorted rows (tile, is_vector, id, v): the queries of a tile come first, its vectors pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, best = None, ([], []), {}

        def close():
            for block in best.values():
                yield block.rows(threshold)

        for batch in batches:
            tiles, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(tiles * 2 + kinds, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tiles[a] != tile:
                    yield from close()
                    tile, waiting, best = tiles[a], ([], []), {}
                ids, vectors = batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a).to_pylist()
                if not kinds[a]:
                    waiting[0].extend(ids.to_pylist())
                    waiting[1].extend(vectors)
                    continue
                if waiting[0]:
                    best = {n: Best(some, v, k) for n, some, v in _vectors(*waiting)}
                    waiting = ([], [])
                for n, some, v in _vectors(ids.to_pylist(), vectors):
                    if n in best:
                        best[n].add(np.array(some, np.int64), np.array(v, np.float64))
        yield from close()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float = 0.75, query_rows: int | None = None, vector_blocks: int | None = None) -> DataFrame:
    """``(query_id, vec_id, similarity, rank)``: the ``k`` most similar vectors of each query by cosine, itself excluded.

    ``vectors`` and ``queries``: (id, v).  Every query block meets every vector block
    in a task of its own, which holds the queries (``query_rows`` of them, by default
    as many as make 32 MB) and lets the vectors pass, so no side is broadcast or
    collected and the plan has the same length for any number of queries.  Each
    task gives at most ``k`` rows a query; the best of those are ranked.  Queries
    are moved once for each of ``vector_blocks`` (by default the shuffle partitions),
    vectors once for each query block.  Similarities are rounded to six places, ties
    go to the smaller id.  Null ids and vectors, other dimensions and vectors of
    norm zero are never found; repeated ids are found as often as they stand.
    """
    spark = vectors.sparkSession
    plain = lambda df: df.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where("id is not null and size(v) > 0")
    wanted, held = plain(queries), plain(vectors)
    n, numbers = wanted.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // query_rows) if query_rows else -(-numbers // BLOCK_NUMBERS))
    parts = vector_blocks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
    each = lambda many, c: F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias(c)
    q = wanted.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("qb"), each(parts, "vb"), F.lit(False).alias("is_vector"), "id", "v")
    x = held.select(each(blocks, "qb"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("vb"), F.lit(True).alias("is_vector"), "id", "v")
    tile = (F.col("qb") * parts + F.col("vb")).alias("tile")
    both = q.unionByName(x).select(tile, "is_vector", "id", "v")
    tiles = both.repartitionById(blocks * parts, F.col("tile")).sortWithinPartitions("tile", "is_vector")
    found = tiles.mapInArrow(_tile(k, threshold), "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
