"""Counters of streaming jobs from their progress events (AG-54): runs, posts, cases and the last duration by job."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "counts"
SCHEMA = "job string, run string, batch long, ts string, input_rows long, duration_ms long, posts long, cases long, error string"


def counted(stream: DataFrame, case: Column) -> DataFrame:
    """The stream with its posts and cases observed on the way; nothing is computed twice."""
    return stream.observe(OBSERVED, F.count("*").alias("posts"), F.coalesce(F.sum(case.cast("long")), F.lit(0)).alias("cases"))


class ProgressTable(StreamingQueryListener):
    """Writes each progress event as one JSON file below ``path``, so a restart never writes an event over another."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self.jvm, self.conf = path.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _write(self, name: str, row: dict) -> None:
        place = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}.json")
        out = place.getFileSystem(self.conf).create(place, True)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        seen = p.observedMetrics.get(OBSERVED)
        row = {
            "job": p.name or str(p.id), "run": str(p.runId), "batch": p.batchId, "ts": p.timestamp, "input_rows": p.numInputRows, "duration_ms": p.batchDuration,
            "posts": seen["posts"] if seen else p.numInputRows, "cases": seen["cases"] if seen else 0, "error": None,
        }
        self._write(f"{p.runId}-{p.batchId}", row)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            self._write(f"{event.runId}-end", {"job": str(event.id), "run": str(event.runId), "error": event.exception})


def job_counters(spark: SparkSession, path: str) -> DataFrame:
    """(job, runs, posts, cases, errors, last_run, last_duration_s) from the written events; a run is one batch."""
    events = spark.read.schema(SCHEMA).json(path)
    return events.groupBy("job").agg(
        F.count("batch").alias("runs"), F.coalesce(F.sum("posts"), F.lit(0)).alias("posts"), F.coalesce(F.sum("cases"), F.lit(0)).alias("cases"), F.count("error").alias("errors"),
        F.max("ts").alias("last_run"), F.round(F.max_by("duration_ms", F.struct("ts", "batch")) / 1000, 2).alias("last_duration_s"),
    )
