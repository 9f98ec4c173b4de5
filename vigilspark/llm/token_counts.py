"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.bpe import loaded
from vigilspark.llm.common import by_row, doc_text


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)``, a row for each row of ``docs``.

    ``tokenizer``: path of a byte-level BPE JSON file, read by the driver.  A map
    over the scan, without a shuffle.  Null text counts as empty (0 bytes, 0
    tokens); null ids and repeated rows are kept as they are; other columns are
    not read; an empty table gives an empty result.  A word of any length is
    merged whole, in O(n log n).
    """
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def rows(source):
        count = loaded(data.value).count
        for i, n_bytes, text in source:
            yield 1, i, n_bytes, count(text)

    plain = doc_text(docs, id_col, text_col).select(
        "id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"), F.coalesce("text", F.lit(""))
    )
    return plain.mapInArrow(by_row(schema, rows), "doc_id long, n_bytes long, n_tokens long")
