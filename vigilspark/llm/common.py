"""Helpers that the corpus operators share."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.storage import materialize

#: Output batches are flushed at about this many characters or list items.
FLUSH = 4_000_000

#: A-Z to a-z on UTF-8 bytes; no byte of a multi-byte character is in A-Z.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Arrow batches of texts: at most so many rows and bytes, since each task holds one or two in each process.
BATCH_ROWS, BATCH_BYTES = 1_000, "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """Sets the session's Arrow batch limits for long texts."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


_HELD: dict = {}


def held(key, make):
    """What a worker process keeps between tasks: one model or memo, the last one asked for.

    Worker processes outlive a stage; keeping one thing lets the next operator
    have the memory of the last.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def doc_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns and their names never matter."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def crc_remainder(id_col: str | Column, mod: int) -> Column:
    """``crc32(id as text) mod`` - the fold rule of the held-out splits; null ids give null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def crc_fold(doc_id: int, mod: int) -> int:
    """The same for one id in Python."""
    return zlib.crc32(str(doc_id).encode()) % mod


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one column, distinct); null matches null.

    The ids are counted first: up to ``broadcast_rows`` they are broadcast and
    the documents stay where they are, beyond that both sides are shuffled.
    """
    ids = materialize(ids.toDF("_gone"), "gone")
    small = F.broadcast(ids) if ids.count() <= broadcast_rows else ids.hint("shuffle_hash")
    return docs.join(small, docs[id_col].cast("long").eqNullSafe(small["_gone"]), "left_anti")


class Emitter:
    """Collects rows and yields record batches of bounded size."""

    def __init__(self, schema: pa.Schema, flush: int = FLUSH) -> None:
        self.schema, self.flush, self.weight = schema, flush, 0
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values, weight: int = 1) -> bool:
        for column, v in zip(self.columns, values, strict=True):
            column.append(v)
        self.weight += weight
        return self.weight >= self.flush

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)]
        self.columns, self.weight = [[] for _ in self.schema], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def by_row(schema: pa.Schema, rows: Callable[[Iterator[tuple]], Iterator[tuple]]) -> Callable:
    """A ``mapInArrow`` function from one that maps tuples to ``(weight, *values)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        out = Emitter(schema)
        for weight, *values in rows(source()):
            if out.add(*values, weight=weight):
                yield out.take()
        yield out.take()

    return run
