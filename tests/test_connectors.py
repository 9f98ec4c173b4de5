"""Feeds by tag and sinks across restarts."""

import json

import pytest
from pyspark.sql import functions as F

from vigilspark.streaming import connectors as C


def post(k, text, ts=None, image=""):
    return {"post_id": f"p{k:02d}", "source": "instagram", "username": "u", "caption_text": text, "post_url": f"/p/{k}", "image": image, "timestamp": ts or f"2024-01-01T00:{59 - k:02d}:00Z"}


def land(folder, name, posts):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(p) for p in posts))


def drain(stream, out, check):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def test_paced_feed_keeps_order_and_repeats_nothing(spark, tmp_path):
    first = [post(k, f"#Invest now {k}" + (" #loan" if k % 4 == 0 else "")) for k in range(8)] + [post(20, ""), post(21, "no tag"), post(22, "x" * 3000 + " #invest")]
    land(tmp_path / "in", "a", first)
    make = lambda: C.paced(C.tagged(C.landed(spark, str(tmp_path / "in")), ["invest", "loan"]), 3)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    drain(make(), out, check)
    got = {}
    for r in spark.read.parquet(out).orderBy("ts").collect():
        got.setdefault(r["tag"], []).append(r["post_id"])
    assert got == {"invest": ["p07", "p06", "p05"], "loan": ["p04", "p00"]}  # the oldest first, the post of 3000 characters was cut
    for n in range(1, 4):
        land(tmp_path / "in", f"b{n}", [first[0], first[7], post(30 + n, f"#invest later {n}", f"2024-02-0{n}T00:00:00Z")])
        drain(make(), out, check)
    rows = [r["post_id"] for r in spark.read.parquet(out).where("tag = 'invest'").orderBy("ts").collect()]
    assert rows == ["p07", "p06", "p05", "p04", "p03", "p02", "p01", "p00", "p31", "p32", "p33"]
    assert len(rows) == len(set(rows))


def test_landed_rules(spark, tmp_path):
    land(tmp_path / "in", "a", [post(1, "free loan offer for you"), post(2, "hi loan"), post(3, "nothing of it at all here"), post(4, "", image="x")])
    C.landed(spark, str(tmp_path / "in"), ["Loan"], min_chars=10).writeStream.format("memory").queryName("landed_rows").trigger(availableNow=True).start().awaitTermination()
    assert [r["post_id"] for r in spark.table("landed_rows").collect()] == ["p01"]


def test_outbox_takes_a_batch_once(spark, tmp_path, monkeypatch):
    schema = "key long, severity string"
    (tmp_path / "in").mkdir()
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    box = C.Outbox(spark, f"{tmp_path}/box", C.routes(), F.col("key").cast("string"))
    (tmp_path / "in" / "a.json").write_text('{"key": 1, "severity": "EMERGENCY"}\n{"key": 2, "severity": "WATCH"}\n{"key": 3, "severity": "HIGH"}\n{"key": 4}\n')
    whole = box.fs.rename

    class Broken:
        def __getattr__(self, name):
            return getattr(fs, name)

        def rename(self, *_):
            raise OSError("lost")

    fs, box.fs = box.fs, Broken()
    with pytest.raises(Exception):
        box.start(stream(), "box", f"{tmp_path}/check").awaitTermination()
    assert not (tmp_path / "box" / "batches").exists() or not list((tmp_path / "box" / "batches").iterdir())
    box.fs = fs
    assert whole is not None
    box.start(stream(), "box", f"{tmp_path}/check").awaitTermination()
    (tmp_path / "in" / "b.json").write_text('{"key": 5, "severity": "CRITICAL"}\n')
    box.start(stream(), "box", f"{tmp_path}/check").awaitTermination()
    box.write(spark.createDataFrame([(9, "HIGH")], schema), 0)  # a batch that comes again is passed over
    got = sorted((r["channel"], r["message"]) for r in spark.read.json(f"{tmp_path}/box/batches").select("channel", F.col("message").cast("string")).collect())
    assert got == sorted([("sms", "1"), ("email", "1"), ("feed", "1"), ("feed", "2"), ("email", "3"), ("feed", "3"), ("feed", "4"), ("email", "5"), ("feed", "5")])


def test_sending_tries_again_and_gives_up(spark, tmp_path):
    folder = str(tmp_path)

    def send(key, message):
        import os

        mark = f"{folder}/{key}"
        n = int(open(mark).read()) if os.path.exists(mark) else 0
        with open(mark, "w") as f:
            f.write(str(n + 1))
        if message == "never" or n < int(message):
            raise ConnectionError("no answer")

    rows = [("a", "0"), ("b", "1"), ("c", "2"), ("d", "3")] + [(f"x{k}", "never") for k in range(5)]
    df = spark.createDataFrame(rows, "key string, message string").coalesce(1)
    got = {r["key"]: (r["attempts"], r["delivered"]) for r in C.sent(df, send, tries=3, pause=0.01, give_up_after=3).collect()}
    assert [got[k] for k in "abcd"] == [(1, True), (2, True), (3, True), (3, False)]
    assert [got[f"x{k}"] for k in range(5)] == [(3, False), (3, False), (0, False), (0, False), (0, False)]
