import json
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pyspark.sql.streaming import StreamingQueryListener

from vigilspark import schemas
from vigilspark.plans import stream_plans
from vigilspark.sources import files, landing
from vigilspark.streaming import monitor as M


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, url_hash string, text string"


def rows(n=60):
    return [(i, T0 + timedelta(minutes=40 * i), i % 3, ("click", "view", "error")[i % 3], float(i * 10), f"u{i // 2}", f"see t.me/ch{i % 4}") for i in range(n)]


def test_dedup_keeps_first(spark, tmp_path):
    got = M.run_available(M.first_seen(stream(spark, tmp_path, rows(), SCHEMA)), "t").collect()
    assert sorted(r["url_hash"] for r in got) == sorted({f"u{i // 2}" for i in range(60)})


def test_windows_equal_batch(spark, tmp_path):
    s = stream(spark, tmp_path, rows(), SCHEMA)
    got = {(r["hour"], r["image"]): (r["n"], r["reach"]) for r in M.run_available(M.spread(s.withColumn("image", F.col("user_id") % 40)), "t").collect()}
    batch = spark.createDataFrame(rows(), SCHEMA).groupBy(F.date_trunc("hour", "ts").alias("h"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v")).collect()
    want = {(r["h"], r["user_id"]): (r["n"], r["v"]) for r in batch}
    assert got and all(want[k] == v for k, v in got.items())
    assert all(k in got for k in want if k[0] < T0 + timedelta(hours=30))


def test_growth_and_alerts(spark, tmp_path):
    s = stream(spark, tmp_path, rows(), SCHEMA)
    growth = M.run_available(M.rolling_growth(s), "t").collect()
    assert max(r["posts"] for r in growth) == 12
    kinds = {r["alert_type"] for r in M.run_available(M.window_alerts(s, thresholds={"estimated_reach": 100}), "t").collect()}
    assert {"RAPID_GROWTH", "HIGH_VICTIM_RISK"} <= kinds


class Kept(StreamingQueryListener):
    """The most state rows that a stream held, and its ends."""

    def __init__(self):
        self.rows, self.ended = 0, 0

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.rows = max([self.rows, *(s.numRowsTotal for s in event.progress.stateOperators)])

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended += 1


def test_growth_state_is_no_larger_than_its_events(spark, tmp_path):
    schema = spark.createDataFrame([], schemas.EVENT).schema
    spark.createDataFrame([(i, T0 + timedelta(hours=7 * i), i % 3, "view", 1.5, None) for i in range(60)], schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    kept = Kept()
    spark.streams.addListener(kept)
    try:
        got = stream_plans.rolling_growth_stream(spark, str(tmp_path)).collect()
        for _ in range(100):
            if kept.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(kept)
    assert kept.ended and kept.rows <= 60
    assert len(got) > 1000 and len({(r["start"], r["user_id"]) for r in got}) == len(got)


def landed(spark, folder, batches):
    """A stream that reads one batch after the other, by the times of their files."""
    schema = "ts timestamp, user_id long, value double"
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            os.utime(f"{folder}/{k}/{name}", (1_700_000_000 + k,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_growth_equals_the_windows_of_the_stream(spark, tmp_path):
    h = lambda x: T0 + timedelta(hours=x)
    batches = [
        [(h(0.2), 1, 1.25), (h(0.7), 1, None), (h(3), 2, 2.5), (None, 1, 9.0), (h(5.5), None, 4.0), (datetime(1969, 12, 1), 1, 7.0)],
        [(h(30), 1, 3.0), (h(2), 1, 5.0)],
        [(h(4), 2, 6.0), (h(29.5), 2, 7.0), (h(-40), 2, 8.0)],  # late: too late for some of its windows, for none, for all
        [(None, 1, 1.0)],
        [(h(31), 3, None), (h(10), 3, 1.0)],
        [(h(200), 3, 1.0)],
        [(h(170), 3, 2.0), (h(100), 3, 2.0)],
    ]
    s = landed(spark, str(tmp_path / "in"), batches)
    for span, slide in (("24 hours", "1 hour"), ("12 hours", "5 hours")):
        want = M.run_available(M.rolling_growth(s, span, slide), "want")
        got = M.drain_growth(s, "got", span, slide)
        assert got.dtypes == want.dtypes and want.count()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (span, slide)


def test_growth_of_nothing(spark, tmp_path):
    s = landed(spark, str(tmp_path / "in"), [[]])
    assert M.drain_growth(s, "t").collect() == [] and M.drain_growth(s, "t").columns == ["start", "end", "user_id", "posts", "reach"]


def test_watch_related_classified(spark, tmp_path):
    s = stream(spark, tmp_path, rows(12), SCHEMA)
    watched = spark.createDataFrame([(1,)], "user_id long")
    assert {r["user_id"] for r in M.run_available(M.watchlist(s, watched), "t").collect()} == {1}
    monitored = spark.createDataFrame([("t.me/ch0",)], "channel string")
    assert {r["channel"] for r in M.run_available(M.related_channels(s, monitored), "t").collect()} == {"t.me/ch1", "t.me/ch2", "t.me/ch3"}
    texts = spark.createDataFrame([("digital arrest",), ("follower sale",), ("x",)], "text string")
    assert [(r["label"], r["severity"], r["alert"]) for r in M.classified(texts).collect()] == [(6, "CRITICAL", True), (11, "LOW", False), (-1, None, None)]
    assert json.loads(M.envelope(texts.limit(1), "POST_FOUND", "text").first()["message"])["type"] == "POST_FOUND"


def test_scheduled_batches(spark, tmp_path):
    seen = []
    q = M.every(stream(spark, tmp_path, rows(5), SCHEMA), 1, lambda df, epoch: seen.append(df.count()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 5


def test_blocklists_and_channels(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"advisory_id": "A1", "date": "d", "blocked_domains": ["x.example"], "blocked_upis": ["u@ybl", ""]}, {"advisory_id": "A2"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"alert_id": "B1", "domains": ["x.example"], "ips": ["1.2.3.4"]}]))
    got = {(r["entity_type"], r["value"], r["source_id"]) for r in files.read_blocklists(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).collect()}
    assert got == {("DOMAIN", "x.example", "A1"), ("UPI", "u@ybl", "A1"), ("DOMAIN", "x.example", "B1"), ("IP", "1.2.3.4", "B1")}
    doc = {"metadata": {}, "channels": [{"channel_metadata": {"username": "c"}, "posts": [{"message_id": 1, "timestamp": "2024-01-01T00:00:00Z", "text": "t"}, {"message_id": 2, "timestamp": "bad"}],
           "entities_found": {"phones": ["1", "1"], "upis": ["u"]}, "media_ratio": {"images": 3.0}}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    channels = files.read_channels(spark, str(tmp_path / "c.json"))
    assert channels.first()["media_ratio"] == {"images": 3.0}
    assert [(r["message_id"], r["ts"]) for r in files.channel_posts(channels).orderBy("message_id").collect()] == [(1, datetime(2024, 1, 1)), (2, None)]
    assert {(r["entity_type"], r["value"]) for r in files.channel_entities(channels).collect()} == {("PHONE", "1"), ("UPI", "u")}


def test_logs_and_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([("k", 1, "a")], "id string, seq int, status string"), path)
    files.append_log(spark.createDataFrame([("k", 2, "b"), ("m", 1, "c")], "id string, seq int, status string"), path)
    log = files.read_log(spark, path, "id string, seq int, status string")
    assert {(r["id"], r["status"]) for r in files.current_state(log, ["id"], [F.desc("seq")]).collect()} == {("k", "b"), ("m", "c")}
    feed, done = spark.range(20), spark.range(5)
    assert files.next_batch(feed, done, "id", 7).count() == 7 and files.next_batch(feed, feed, "id", 7).count() == 0
    mixed = files.mix(spark.range(50), spark.range(100, 200), "id", 20)
    assert mixed.groupBy("origin").count().where("origin = 'real'").first()["count"] == 6
    assert files.first_available(spark.range(0), spark.range(3)).count() == 3
    files.export_csv(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    assert files.taxonomy(spark).count() == 14


def test_landing_source(spark, tmp_path):
    long = {"post_id": "1", "source": "s", "caption_text": "Invest " + "x" * 3000}
    lines = [long, {"post_id": "2", "caption_text": ""}, {"post_id": "3", "caption_text": "", "image": "i.png"}, {"post_id": "4", "caption_text": "hello"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    landing.register(spark)
    got = {r["post_id"]: r for r in spark.read.format("landing").load(str(tmp_path)).collect()}
    assert set(got) == {"1", "3", "4"} and len(got["1"]["caption_text"]) == 2000
    assert [r["post_id"] for r in spark.read.format("landing").option("keywords", "invest").load(str(tmp_path)).collect()] == ["1"]


def test_result_sinks(spark, tmp_path):
    from vigilspark.sources import files as S

    prints = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), ("b", None)], "channel string, vector array<double>")
    S.write_by_channel(prints, str(tmp_path / "prints"))
    back = S.read_by_channel(spark, str(tmp_path / "prints"), "channel string, vector array<double>")
    assert sorted((r["channel"], r["vector"]) for r in back.collect() if r["vector"]) == [("a", [1.0, 2.0])] * 2 and back.count() == 3
    acts = spark.createDataFrame([(1, "BLOCK"), (2, "BLOCK"), (3, "NONE")], "channel long, final_action string")
    S.write_recommendations(acts, str(tmp_path / "rec"))
    assert {r["final_action"]: r["n"] for r in spark.read.json(str(tmp_path / "rec" / "actions")).collect()} == {"BLOCK": 2, "NONE": 1}
    S.write_attribution(spark.createDataFrame([(1, 2, 0.3), (1, 3, 0.9)], "a long, b long, probability double").coalesce(1), str(tmp_path / "att"))
    assert [r["b"] for r in spark.read.parquet(str(tmp_path / "att")).collect()] == [3, 2]
    (tmp_path / "ocr").mkdir()
    for k in range(3):
        (tmp_path / "ocr" / f"{k}.json").write_text('{"image": "i%d", "text": "t%d"}' % (k, k))
    assert [r["image"] for r in S.ocr_texts(spark, str(tmp_path / "ocr"), 2).collect()] == ["i0", "i1"]
