"""BPE encoding and decoding of whole texts."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.bpe import loaded
from vigilspark.llm.common import FLUSH, doc_text


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)``, a row for each row of ``docs``.

    Words are merged through a priority queue of ranks over a doubly linked list
    of symbols; decoding joins the vocabulary's byte strings of the ids.  A map
    over the scan, without a shuffle; ids are gathered in flat int buffers and
    flushed at a bounded size.  Null text is encoded as empty (no ids, decoded
    ""); null ids and repeated rows are kept; other columns are not read.
    """
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches):
        bpe = loaded(data.value)
        keys, ends, packed, texts, size = [], [0], [], [], 0

        def block():
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed.append(bpe.encode_packed(text or ""))
                keys.append(i)
                ends.append(ends[-1] + len(packed[-1]) // 4)
                texts.append(bpe.decode(np.frombuffer(packed[-1], np.int32).tolist()))
                size += len(packed[-1]) // 4 + len(texts[-1])
                if size >= FLUSH:
                    yield block()
                    keys, ends, packed, texts, size = [], [0], [], [], 0
        yield block()

    return doc_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_decode_digest(coded: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of :func:`bpe_round_trip`'s rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
