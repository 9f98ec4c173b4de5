"""Feeds with order and limits by tag, and sinks that commit a batch once (SC-13 to SC-15, SC-30, SC-31, SC-35, RM-3).

Posts land as JSON lines in any folder that Spark reads; its file source keeps the
offsets.  :func:`paced` lets a few posts of each tag through in a micro-batch, the
oldest first, and keeps the others, and what it has seen, as state.  :class:`Outbox`
writes a batch beside its place and renames it, so a restart neither repeats nor
loses a row; :func:`sent` hands messages to an endpoint with retries.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilspark.sources.landing import CAPTION, SCHEMA
from vigilspark.streaming.stateful import with_store


def landed(spark: SparkSession, folder: str, keywords: list[str] | None = None, min_chars: int = 0, files_a_batch: int = 64) -> DataFrame:
    """The stream of posts below ``folder`` (SC-13 to SC-15): captions cut, rows without text and image left out.

    With ``keywords`` only texts that hold one of them stay; ``min_chars`` is the least length of a text.
    """
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)
    text = F.substring(F.coalesce("caption_text", F.lit("")), 1, CAPTION)
    rows = raw.withColumn("caption_text", text).where("post_id is not null and (caption_text <> '' or coalesce(image, '') <> '')")
    rows = rows.where(F.length("caption_text") >= min_chars).withColumn("ts", F.try_to_timestamp("timestamp"))
    if keywords:
        low = F.lower("caption_text")
        rows = rows.where(F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: low.contains(k)))
    return rows


def tagged(posts: DataFrame, tags: list[str], hashtags: bool = True) -> DataFrame:
    """A row for each post and watched tag: ``#tag`` in its text, or the tag as a plain word."""
    low = F.lower("caption_text")
    wanted = F.array(*[F.lit(t.lower()) for t in tags])
    found = F.array_intersect(F.regexp_extract_all(low, F.lit(r"#(\w+)"), F.lit(1)), wanted) if hashtags else F.filter(wanted, lambda t: low.contains(t))
    return posts.select("*", F.explode(found).alias("tag"))


PACED = "tag string, post_id string, ts timestamp, caption_text string, post_url string, username string"
_FIELDS = ("post_id", "ts", "caption_text", "post_url", "username")


class Paced(StatefulProcessor):
    """The posts of a tag in order of time, ``limit`` in a batch, each once."""

    def __init__(self, limit: int, pause_ms: int | None) -> None:
        self.limit, self.pause_ms = limit, pause_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "post_id string, ts timestamp, caption_text string, post_url string, username string")
        self.seen = handle.getMapState("seen", "post_id string", "known boolean")

    def _next(self, key: tuple, posts: list[tuple]) -> Iterator[Row]:
        posts.sort(key=lambda p: (p[1] is None, p[1].timestamp() if p[1] else 0, p[0]))
        now, rest = posts[: self.limit], posts[self.limit :]
        self.waiting.put(rest) if rest else self.waiting.clear()
        for post in now:
            yield Row(tag=key[0], **dict(zip(_FIELDS, post, strict=True)))

    def _again(self, timer_values) -> None:
        if self.pause_ms is not None and self.waiting.exists():
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.pause_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        posts = [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        for row in rows:
            if not self.seen.containsKey((row["post_id"],)):
                self.seen.updateValue((row["post_id"],), (True,))
                posts.append(tuple(row[c] for c in _FIELDS))
        yield from self._next(key, posts)
        self._again(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.waiting.exists():
            yield from self._next(key, [tuple(p) for p in self.waiting.get()])
            self._again(timerValues)

    def close(self) -> None:
        pass


def paced(posts: DataFrame, per_tag: int = 3, pause_seconds: int | None = None) -> DataFrame:
    """At most ``per_tag`` posts of each tag in a micro-batch (RM-3), the oldest first; the rest follow with the next posts of the tag.

    ``posts``: stream of :func:`tagged`.  A post that comes again is dropped; state is kept by tag.
    ``pause_seconds`` lets the rest follow after a pause without new posts as well; such a stream never
    ends by itself, so it is for scheduled triggers, not for ``availableNow``.
    """
    rows = with_store(posts).select("tag", *_FIELDS)
    return rows.groupBy("tag").transformWithState(Paced(per_tag, None if pause_seconds is None else pause_seconds * 1000), PACED, "Append", "None" if pause_seconds is None else "ProcessingTime")


class Outbox:
    """A sink of ``path/batches/batch=<id>/channel=<name>`` that takes each batch of a stream once (SC-31, SC-35).

    ``Outbox(...).start(stream, name, checkpoint)``: a batch is written below ``_staging``
    and renamed when it is whole.  A batch that fails is removed there and comes
    again with its number; one that is in place already is passed over.
    """

    def __init__(self, spark: SparkSession, path: str, channel: Column, message: Column) -> None:
        self.path, self.channel, self.message = path.rstrip("/"), channel, message
        self.Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, batch: DataFrame, number: int) -> None:
        place, staging = self.Path(f"{self.path}/batches/batch={number}"), self.Path(f"{self.path}/_staging/{number}")
        if self.fs.exists(place):
            return
        routed = batch.select(F.explode(self.channel).alias("channel"), self.message.alias("message"))
        try:
            routed.write.mode("overwrite").partitionBy("channel").json(str(staging))
            self.fs.mkdirs(place.getParent())
            if not self.fs.rename(staging, place):
                raise OSError(f"{staging} could not be moved to {place}")
        except Exception:
            self.fs.delete(staging, True)
            raise

    def start(self, stream: DataFrame, name: str, checkpoint: str, **trigger):
        writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(self.write)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


#: Where alerts of a severity go.
ROUTES = {"EMERGENCY": ["sms", "email", "feed"], "CRITICAL": ["email", "feed"], "HIGH": ["email", "feed"]}


def routes(severity: str = "severity") -> Column:
    """Channels of an alert by its severity (PR-17, SC-35); all others go to the feed alone."""
    out = F.array(F.lit("feed"))
    for level, channels in reversed(ROUTES.items()):
        out = F.when(F.col(severity) == level, F.array(*[F.lit(c) for c in channels])).otherwise(out)
    return out


def sent(messages: DataFrame, send: Callable[[str, str], None], tries: int = 3, pause: float = 0.5, give_up_after: int = 20) -> DataFrame:
    """``(key, attempts, delivered, error)`` of messages (key, message) handed to ``send(key, message)`` on the executors (SC-30, SC-31).

    A failed call is tried again after ``pause``, then twice as long, up to ``tries`` calls.
    After ``give_up_after`` messages in a row without success a task takes its endpoint for dead and
    reports the rest with no attempt.  A lost task sends its messages again, so endpoints
    tell repeats by the key.
    """

    def run(batches):
        dead = 0
        for batch in batches:
            out = []
            for key, message in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                error, attempt = "endpoint taken for dead", 0
                while dead < give_up_after and attempt < tries:
                    attempt += 1
                    try:
                        send(key, message)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever an endpoint raises is a failed call
                        error = f"{type(e).__name__}: {e}"
                        if attempt < tries:
                            time.sleep(pause * 2 ** (attempt - 1))
                dead = 0 if error is None else dead + 1
                out.append((key, attempt, error is None, error))
            keys, attempts, done, errors = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(attempts, pa.int32()), pa.array(done, pa.bool_()), pa.array(errors, pa.string())], ["key", "attempts", "delivered", "error"]
            )

    plain = messages.select(F.col("key").cast("string").alias("key"), F.col("message").cast("string").alias("message"))
    return plain.mapInArrow(run, "key string, attempts int, delivered boolean, error string")
