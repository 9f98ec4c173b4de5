"""Ordered digests against plain joins, and the counters of a drained stream."""

import hashlib
import random
import time

from pyspark.sql import functions as F

from vigilspark.operators.folds import ordered_sha256
from vigilspark.streaming import progress as P


def test_digests_equal_joined_texts(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "bc", None, "\u00e9", "d"]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g long, t string, o long").repartition(7)
    held = {}
    for g, t, o in rows:
        held.setdefault(g, []).append((o, t or ""))
    want = {g: hashlib.sha256("".join(t for _, t in sorted(v)).encode()).hexdigest() for g, v in held.items()}
    assert {r["g"]: r["digest"] for r in ordered_sha256(df, "g", "t", ["o"]).collect()} == want
    assert ordered_sha256(df.where("false"), "g", "t").count() == 0


def test_counters_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    listener = P.ProgressTable(spark, f"{tmp_path}/events")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        job = P.counted(stream, F.col("id") % 5 == 0).writeStream.queryName("scrape").format("parquet").option("path", f"{tmp_path}/out")
        job.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
        for _ in range(100):
            if len(list((tmp_path / "events").glob("*.json")) if (tmp_path / "events").exists() else []) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    (row,) = P.job_counters(spark, f"{tmp_path}/events").collect()
    assert (row["job"], row["runs"], row["posts"], row["cases"], row["errors"]) == ("scrape", 3, 30, 6, 0) and row["last_duration_s"] >= 0
