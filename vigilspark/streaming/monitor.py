"""Structured Streaming jobs of the monitor (ST-1..13).

Every job is a function from a streaming DataFrame to a streaming DataFrame, with
a watermark where it keeps state; :func:`run_available` drains what has landed and
stops, so the same jobs serve schedules and tests.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.functions import fixed as X
from vigilspark.functions import text as T
from vigilspark.storage import drop_path, new_path

LATE = "1 hour"
#: Rows of parts that one task rolls up into windows.
PART_ROWS = 50_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The post stream (ST-1): files of the landing folder, times as instants."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(schemas.EVENT).option("maxFilesPerTrigger", 64)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)  # a stream watches folders
    else:
        raw = reader.parquet(path)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def first_seen(posts: DataFrame, key: str = "url_hash", late: str | None = None) -> DataFrame:
    """Posts whose key was not seen in the stream's lifetime (ST-5).

    The state holds every key, spread over the shuffle partitions; give ``late``
    to keep keys only within that watermark.
    """
    if late is None:
        return posts.dropDuplicates([key])
    return posts.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def rolling_growth(posts: DataFrame, span: str = "24 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """Posts and reach of each channel in sliding windows (ST-6), as a stream with a state row for each open window; :func:`drain_growth` keeps none."""
    w = posts.withWatermark("ts", late).groupBy(F.window("ts", span, slide).alias("w"), "user_id")
    return w.agg(F.count("*").alias("posts"), F.round(F.sum("value"), 2).alias("reach")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "posts", "reach")


def window_alerts(posts: DataFrame, span: str = "24 hours", late: str = LATE, thresholds: dict | None = None) -> DataFrame:
    """Threshold alerts of each day's activity in long form (ST-7, ST-9)."""
    t = X.ALERT_THRESHOLDS | (thresholds or {})
    day = posts.withWatermark("ts", late).groupBy(F.window("ts", span).alias("w"), "user_id").agg(
        F.count("*").alias("posts"), F.sum("value").alias("reach"), F.size(F.collect_set("event_type")).alias("platforms")
    )
    made = F.array_compact(
        F.array(
            F.when(F.col("posts") >= t["new_channels_24h"], F.struct(F.lit("RAPID_GROWTH").alias("alert_type"), F.lit("CRITICAL").alias("severity"))),
            F.when(F.col("reach") >= t["estimated_reach"], F.struct(F.lit("HIGH_VICTIM_RISK").alias("alert_type"), F.lit("CRITICAL").alias("severity"))),
            F.when(F.col("platforms") >= t["platforms"], F.struct(F.lit("CROSS_PLATFORM").alias("alert_type"), F.lit("EMERGENCY").alias("severity"))),
        )
    )
    rows = day.select(F.col("w.start").alias("day"), "user_id", F.explode(made).alias("a"))
    return rows.select("day", "user_id", "a.alert_type", "a.severity")


def spread(appearances: DataFrame, image: str = "image", late: str = LATE) -> DataFrame:
    """Appearances of each image by hour (ST-11)."""
    g = appearances.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), F.col(image).alias("image"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("reach")).select(F.col("w.start").alias("hour"), "image", "n", "reach")


def watchlist(posts: DataFrame, watched: DataFrame) -> DataFrame:
    """Posts of watched channels (ST-12): a stream-static join, so the list may change between batches."""
    return posts.join(watched, "user_id")


def related_channels(posts: DataFrame, monitored: DataFrame) -> DataFrame:
    """Channels linked from texts that are not monitored yet (ST-10)."""
    found = posts.select(F.explode(T.telegram_links(F.col("text"))).alias("channel")).where(F.col("channel").startswith("t.me/"))
    return found.join(monitored, "channel", "left_anti")


def classified(posts: DataFrame) -> DataFrame:
    """Label and alert flag of each text (ST-3): severe categories with a confidence above 0.6 raise an alert."""
    severity = F.create_map(*[F.lit(x) for k, c in enumerate(X.CATEGORIES) for x in (k, c[3])])
    label = T.heuristic_label(F.col("text"))
    out = posts.withColumn("label", label)
    return out.withColumn("severity", severity[F.col("label")]).withColumn("alert", F.col("severity").isin("CRITICAL", "HIGH"))


def envelope(df: DataFrame, event_type: str, *columns: str) -> DataFrame:
    """JSON messages for subscribers (ST-9)."""
    return df.select(F.to_json(F.struct(F.lit(event_type).alias("type"), F.struct(*columns).alias("data"))).alias("message"))


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Drain what is there into Parquet with a checkpoint (ST-13) and read the result."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _micros(spark: SparkSession, *spans: str) -> list[int]:
    zero = F.timestamp_seconds(F.lit(0))
    return list(spark.range(1).select(*[F.unix_micros(zero + F.expr(f"INTERVAL {s}")) for s in spans]).first())


def drain_growth(posts: DataFrame, name: str, span: str = "24 hours", slide: str = "1 hour", late: str = LATE) -> DataFrame:
    """The rows of :func:`rolling_growth` over what has landed, without a state row for each window of a post.

    A micro-batch leaves one row for each channel and hour (the longest time that divides
    ``span`` and ``slide``) in the shared folder.  A window is summed from these once, when
    the watermark has passed its end, so a post counts in every window still open when it
    comes.  As in Spark's own windows, a batch sees the watermark of the batches before it.
    """
    spark = posts.sparkSession
    schema = rolling_growth(posts, span, slide, late).schema
    span_us, slide_us, late_us = _micros(spark, span, slide, late)
    part = f"{gcd(span_us, slide_us)} microseconds"
    path, parts = new_path(spark, name), new_path(spark, f"{name}_parts")
    marks, batches, written = [0, 0], [], []  # marks: the watermark before each batch, after the last of all

    def close(to: str) -> None:
        after, until = marks[-2:]
        batches[:] = [b for b in batches if b[2] > after - span_us]  # older parts are in closed windows only
        if until == after or not batches:
            return
        at = lambda us: F.timestamp_micros(us if isinstance(us, Column) else F.lit(us))
        rows = spark.read.parquet(*[p for p, _, _ in batches]).where((F.col("at") > at(after - span_us)) & (F.col("at") < at(until)))
        dealt = rows.repartition(ceil(sum(n for _, n, _ in batches) / PART_ROWS), "user_id")
        # starts of the windows that hold a part, exploded: F.window would lose the partitioning, and all windows were shuffled
        us, first = F.unix_micros("at"), F.unix_micros("at") - F.lit(span_us)
        starts = F.sequence(us - F.pmod(us, F.lit(slide_us)), first + F.lit(slide_us) - F.pmod(first, F.lit(slide_us)), F.lit(-slide_us))
        held = dealt.select("user_id", "posts", "reach", F.explode(starts).alias("s")).where((F.col("s") > after - span_us) & (F.col("s") <= until - span_us))
        w = held.groupBy("user_id", "s").agg(F.sum("posts").alias("posts"), F.round(F.sum("reach"), 2).alias("reach"))
        closed = w.select(at(F.col("s")).alias("start"), at(F.col("s") + span_us).alias("end"), "user_id", "posts", "reach")
        closed.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(to)
        written.append(to)

    def handle(batch: DataFrame, epoch: int) -> None:
        to = f"{parts}/{epoch}"
        hours = batch.groupBy(F.window("ts", part).alias("w"), "user_id").agg(F.count("*").alias("posts"), F.sum("value").alias("reach"), F.max("ts").alias("last"))
        hours.select(F.col("w.start").alias("at"), "user_id", "posts", "reach", "last").write.parquet(to)
        n, last = spark.read.parquet(to).agg(F.count("*"), F.unix_micros(F.max("last"))).first()
        if n:
            batches.append((to, n, last))
        close(f"{path}/{epoch}")
        marks.append(max(marks[-1], last - late_us) if n else marks[-1])

    posts.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).start().awaitTermination()
    close(f"{path}/end")
    drop_path(spark, parts)
    return spark.read.schema(schema).parquet(*written) if written else spark.createDataFrame([], schema)


def every(stream: DataFrame, minutes: int, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """A scheduled micro-batch job (ST-2, ST-4, SC-31, SC-35): ``handle`` gets each batch once for each epoch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{minutes} minutes").start()
