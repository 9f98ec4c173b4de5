"""The corpus pipeline: five stages from raw documents to token digests.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything that its
predecessor kept; :func:`run` writes each result as Parquet in the cluster's
shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import lang_id
from vigilspark.llm.bpe_codec import bpe_round_trip, encode_decode_digest
from vigilspark.llm.common import without_ids
from vigilspark.llm.decontam import contamination
from vigilspark.llm.line_dedup import line_dedup
from vigilspark.llm.queries import table, tokenizer_path
from vigilspark.llm.simhash import simhash_components
from vigilspark.storage import materialize

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identified language go: no letters, or a posterior under one half."""
    return lang_id.keep_identified(docs.select(*DOCUMENT), lang_id.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, except in the smallest document that holds them; ``n_chars`` follows the text."""
    cleaned = line_dedup(docs, carry=("lang", "source"))
    return cleaned.select("doc_id", "text", "carried.lang", "carried.source", F.length("text").cast("long").alias("n_chars"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own in ``_row``, written: ids may be null or repeat, so stages decide by row."""
    return materialize(docs.select(*DOCUMENT).withColumn("_row", F.monotonically_increasing_id()), "rows")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row stays: the smallest id, null after all others, then the first row."""
    rows = keyed_rows(docs)
    found = materialize(simhash_components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"), "found")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    gone = found.select("_row").join(kept.select(F.col("first._row").alias("_row")), "_row", "left_anti")
    return without_ids(rows, gone, "_row").drop("_row")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go, whatever rows share their id."""
    rows = keyed_rows(docs)
    found = contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_row")
    return without_ids(rows, found.select("doc_id").distinct(), "_row").drop("_row")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text decoded from them."""
    return encode_decode_digest(bpe_round_trip(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encode_decode", token_stage),
]

#: Learned models, similarity search and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
