"""Readers and sinks for the documents, logs and exports of the domain (SC-1..12, SC-16, SC-20..22, SC-27, SC-33, SC-36, SC-37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.functions import fixed as X
from vigilspark.operators.cases import latest_per_key

#: Blocklist columns of advisories and alerts and the entity type each holds.
BLOCK_COLUMNS = {
    "blocked_domains": "DOMAIN", "blocked_urls": "URL", "blocked_channels": "CHANNEL", "blocked_upis": "UPI", "blocked_phones": "PHONE", "domains": "DOMAIN", "ips": "IP",
}


def read_blocklists(spark: SparkSession, advisories: str, alerts: str) -> DataFrame:
    """(entity_type, value, source_id, date), distinct, from two feeds of JSON arrays (SC-3, SE-2)."""
    parts = []
    for path, schema, key in ((advisories, schemas.ADVISORY, "advisory_id"), (alerts, schemas.ALERT, "alert_id")):
        docs = spark.read.schema(schema).option("multiLine", True).json(path)
        for column in docs.columns:
            if column in BLOCK_COLUMNS:
                parts.append(docs.select(F.lit(BLOCK_COLUMNS[column]).alias("entity_type"), F.explode(column).alias("value"), F.col(key).alias("source_id"), "date"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("value is not null and value <> ''").distinct()


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """Channel documents, one row each, from a dataset file ``{metadata, channels[]}`` (SC-4)."""
    fields = schemas.CHANNEL.replace(" struct", ":struct").replace(" array", ":array").replace(" map", ":map").replace(" double", ":double").replace(" string", ":string")
    data = spark.read.schema(f"channels array<struct<{fields}>>").option("multiLine", True).json(path)
    return data.select(F.explode("channels").alias("c")).select("c.*")


def channel_posts(channels: DataFrame) -> DataFrame:
    """The posts of channel documents as rows, with parsed times (SC-17)."""
    rows = channels.select(F.col("channel_metadata.username").alias("channel"), F.explode("posts").alias("p"))
    return rows.select("channel", "p.*").withColumn("ts", F.try_to_timestamp(F.regexp_replace("timestamp", "Z$", "+00:00"))).drop("timestamp")


def channel_entities(channels: DataFrame) -> DataFrame:
    """(channel, entity_type, value) of channel documents."""
    lists = {"PHONE": "phones", "UPI": "upis", "URL": "urls"}
    typed = F.flatten(F.array(*[F.transform(F.coalesce(f"entities_found.{c}", F.array().cast("array<string>")), _tag(k)) for k, c in lists.items()]))
    return channels.select(F.col("channel_metadata.username").alias("channel"), F.explode(typed).alias("e")).select("channel", "e.*").distinct()


def _tag(kind: str):
    def tag(value: Column) -> Column:
        return F.struct(F.lit(kind).alias("entity_type"), value.alias("value"))

    return tag


def taxonomy(spark: SparkSession, overlay: DataFrame | None = None) -> DataFrame:
    """Categories with their keywords (SC-5, SC-37); rows of ``overlay`` with new ids are added, built-in ones win."""
    rows = [(i, label, group, severity, priority, law, en, hi) for i, label, group, severity, priority, law, en, hi in X.CATEGORIES]
    own = spark.createDataFrame(rows, "id string, label string, grp string, severity string, priority int, law string, english array<string>, hindi array<string>")
    return own if overlay is None else own.unionByName(overlay.join(own.select("id"), "id", "left_anti").select(*own.columns))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSONL log (SC-6, SC-32)."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL log; lines that are no JSON come back as nulls and are dropped (SC-7)."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.dropna(how="all")


def current_state(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Upsert table as the latest row of each key of an append-only log (SC-11, SC-27)."""
    return latest_per_key(log, key, order)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with header (SC-12)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_channel(df: DataFrame, path: str, channel: str = "channel", most_rows: int = 1_000_000) -> None:
    """Rows as JSON in one folder for each channel (SC-8, SC-33): fingerprints and evidence packages.

    Rows are rebalanced by channel first, so a small channel is one file and not one from
    every task, and adaptive execution splits a channel with most rows among writers by
    size.  A file ends after ``most_rows`` rows.
    """
    df.hint("rebalance", F.col(channel)).write.mode("append").option("maxRecordsPerFile", most_rows).partitionBy(channel).json(path)


def read_by_channel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What :func:`write_by_channel` wrote, the channel from the folder (SC-8)."""
    return spark.read.schema(schema).json(path)


def write_recommendations(recommended: DataFrame, path: str) -> None:
    """Recommendations and the count of each action as two JSON tables below ``path`` (SC-9)."""
    recommended.write.mode("overwrite").json(f"{path}/recommendations")
    recommended.groupBy("final_action").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/actions")


def write_attribution(pairs: DataFrame, path: str) -> None:
    """Attribution pairs as Parquet, sorted by probability within each file, so that readers skip weak ones (SC-10, SO-6)."""
    pairs.sortWithinPartitions(F.desc("probability"), "a", "b").write.mode("overwrite").parquet(path)


def ocr_texts(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """Recognised texts of a cache folder of JSON files, at most ``limit`` by path (SC-33)."""
    rows = spark.read.schema("image string, text string").option("multiLine", True).json(path)
    return rows.select("image", "text", F.col("_metadata.file_path").alias("path")).where("text is not null").orderBy("path").limit(limit)


def recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows, newest first (SC-16, SO-8, RM-5)."""
    return df.orderBy(*order).limit(n)


def next_batch(feed: DataFrame, ingested: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A random batch of rows not ingested yet, in a seeded order (SC-20); empty when the feed is exhausted, see :func:`next_batch_or_reset`."""
    fresh = feed.join(ingested.select(key).distinct(), key, "left_anti")
    return fresh.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def next_batch_or_reset(feed: DataFrame, ingested: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, bool]:
    """:func:`next_batch`, and whether the feed was exhausted and so began anew (SC-20).

    After a reset the caller forgets what was ingested and keeps only this batch.
    """
    batch = next_batch(feed, ingested, key, n, seed)
    if not batch.isEmpty():
        return batch, False
    return next_batch(feed, ingested.limit(0), key, n, seed + 1), True


def mix(real: DataFrame, synthetic: DataFrame, key: str, n: int, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """``n`` rows of which a share of ``ratio`` is real, the rest synthetic (SC-21)."""
    some = lambda df, k: df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)
    k = round(n * ratio)
    return some(real, k).withColumn("origin", F.lit("real")).unionByName(some(synthetic, n - k).withColumn("origin", F.lit("synthetic")))


def first_available(*sources: DataFrame) -> DataFrame:
    """The first source with rows (SC-22); the last one if none has."""
    for source in sources[:-1]:
        if not source.isEmpty():
            return source
    return sources[-1]


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """(path, split, label, sha256) of labelled image folders ``root/split/label/file`` (SC-26, RM-14)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower("path").rlike(r"\.(jpg|jpeg|png|webp)$"))
    parts = lambda k: F.element_at(F.split("path", "/"), -k)
    return files.select("path", parts(3).alias("split"), parts(2).alias("label"), F.sha2("content", 256).alias("sha256"))


def evaluation_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Reports of several models as one table (SC-36, RM-6)."""
    out = None
    for path in paths:
        part = spark.read.schema("model string, metric string, value double").json(path)
        out = part if out is None else out.unionByName(part)
    return out
