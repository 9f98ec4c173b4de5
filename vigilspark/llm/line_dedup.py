"""Line deduplication across documents.

Lines are normalised and hashed in the scan; (hash, document) pairs are counted
with map-side pre-aggregation, so a line that a third of all documents hold is
one small row for each task; the pairs to drop come from an equi join on the
hash whose large side adaptive execution can split; each document then meets
only its own list of hashes.  Rows are told apart by id and a hash of their text, so that
the lists of many rows with one id, or with none, are never one group.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigilspark.llm.common import LOWER_AZ, by_row, doc_text
from vigilspark.storage import materialize

#: A null id stands after all others.
_LAST = (1 << 63) - 1


def line_keys(text: str, min_chars: int) -> list[tuple[int, int] | None]:
    """128-bit hash of each line's key, None for keys that are too short to count."""
    found = []
    for raw in text.encode().translate(LOWER_AZ).split(b"\n"):
        key = raw.strip(b" \t\n\x0b\x0c\r")
        # a UTF-8 character has at most four bytes, so most lines need no count of code points
        if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
            found.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(key)
            found.append(((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)))
    return found


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped)``, a row for each row of ``docs``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in
    lower case.  Keys of at least ``min_chars`` code points found in at least
    ``min_docs`` distinct documents lose all their lines except in the smallest
    id holding them; the other lines stay, joined by newline in their order.

    Null or empty text is one empty line.  A null id counts as one more document
    after all others.  Rows that repeat an id are one document for the count and
    are each cleaned.  Of the other columns only those in ``carry`` are read; they
    come back in the struct ``carried``.  An empty table gives an empty result.
    Lines are matched by 128-bit hash.
    """
    more = [F.struct(*carry).alias("carried")] if carry else []
    plain = doc_text(docs, id_col, text_col, *more).select(
        F.coalesce("id", F.lit(_LAST)).alias("k"), "id", F.coalesce("text", F.lit("")).alias("text"), *(["carried"] if carry else [])
    ).withColumn("r", F.xxhash64("text"))
    key_schema = pa.schema([("k", pa.int64()), ("r", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64())])

    def keys(source):
        for k, r, text in source:
            for hi, lo in {h for h in line_keys(text, min_chars) if h}:
                yield 1, k, r, hi, lo

    lines = materialize(
        plain.select("k", "r", "text").mapInArrow(by_row(key_schema, keys), "k long, r long, hi long, lo long"), "lines"
    )
    groups = lines.groupBy("hi", "lo")
    if min_docs <= 2:  # two distinct documents: the smallest and the largest id differ
        wide = groups.agg(F.min("k").alias("keeper"), F.max("k").alias("top"))
        wide = wide.where("keeper < top") if min_docs == 2 else wide
    else:
        wide = groups.agg(F.min("k").alias("keeper"), F.count_distinct("k").alias("n")).where(F.col("n") >= min_docs)
    # written, so that both sides of the join are plain exchanges and a hot hash is split among tasks
    wide = materialize(wide.select("hi", "lo", "keeper"), "wide")
    drops = (
        lines.join(wide, ["hi", "lo"])
        .where("k > keeper")
        .groupBy("k", "r")
        .agg(F.collect_set(F.struct("hi", "lo")).alias("drops"))
    )
    out = T.StructType.fromDDL("doc_id long, text string, n_lines long, n_dropped long")
    if carry:
        out.add(plain.schema["carried"])
    out_schema = to_arrow_schema(out)

    def rebuild(source):
        for i, text, dropped, *carried in source:
            lines = text.split("\n")
            total = len(lines)
            if dropped:
                gone = {(d["hi"], d["lo"]) for d in dropped}
                lines = [x for x, h in zip(lines, line_keys(text, min_chars), strict=True) if h not in gone]
                text = "\n".join(lines)
            yield len(text), i, text, total, total - len(lines), *carried

    joined = plain.join(drops.hint("shuffle_hash"), ["k", "r"], "left").select("id", "text", "drops", *(["carried"] if carry else []))
    return joined.mapInArrow(by_row(out_schema, rebuild), out)
