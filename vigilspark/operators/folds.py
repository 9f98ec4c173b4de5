"""Folds over the rows of a key in order, as streams: no group is ever one row (AG-28)."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_sha256(df: DataFrame, key: str, text: str, order: list[str] | None = None) -> DataFrame:
    """``(key, digest)``: SHA-256 of the texts of each key, one after the other by ``order`` (the text itself by default), nulls first.

    Rows are sorted within partitions and pass a running digest, so a key of any size
    takes the memory of one batch; a digest is sequential, so a key is one task's.
    Null texts are empty; a null key is a key like others.
    """
    out = T.StructType([df.schema[key], T.StructField("digest", T.StringType())])
    schema = to_arrow_schema(out)

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        keys, digests = [], []
        for k, some in groupby(rows(), key=lambda r: r[0]):
            running = hashlib.sha256()
            for _, value in some:
                running.update((value or "").encode())
            keys.append(k)
            digests.append(running.hexdigest())
            if len(keys) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), pa.array(digests, pa.string())], schema=schema)
                keys, digests = [], []
        yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), pa.array(digests, pa.string())], schema=schema)

    by = order or [text]
    sorted_rows = df.select(key, F.col(text).cast("string").alias("_text"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(by)])
    sorted_rows = sorted_rows.repartition(key).sortWithinPartitions(key, *[f"_o{k}" for k in range(len(by))])
    return sorted_rows.select(key, "_text").mapInArrow(run, out)
