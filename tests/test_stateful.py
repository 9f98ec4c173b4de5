"""Keyed state against a plain fold over all rows, with restarts between the parts of a stream."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilspark.streaming import stateful as K

START = datetime(2024, 1, 1)
POST = "id long, campaign long, channel long, platform string, reach double, ts timestamp"
ACK = "id long, campaign long, alert_id string, ts timestamp"
SEEN = "id long, image long, ts timestamp, platform string, channel long, reach long"


def drained(spark, make, folders, parts, out):
    """Runs the stream once for each part, with one checkpoint: every run starts anew where the last one ended."""
    for part in parts:
        for name, rows, schema in part:
            if rows:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folders}/{name}")
        stream = make()
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def fold(posts, acks):
    """Alerts of one list of rows in order of time, the plain way."""
    state, out = {}, []
    for ts, i, campaign, row in sorted([(r[5], r[0], r[1], r) for r in posts] + [(r[3], r[0], r[1], r) for r in acks], key=lambda x: x[:3]):
        s = state.setdefault(campaign, {"first": {}, "platforms": set(), "reach": 0.0, "holding": set(), "n": 0, "open": {}})
        if len(row) == 4:
            s["open"].pop(row[2], None)
            continue
        s["first"].setdefault(row[2], ts)
        s["platforms"].add(row[3])
        s["reach"] += row[4]
        fresh = sum(t > ts - timedelta(days=1) for t in s["first"].values())
        for kind, holds in (("RAPID_GROWTH", fresh >= 5), ("HIGH_VICTIM_RISK", s["reach"] >= 500), ("CROSS_PLATFORM", len(s["platforms"]) >= 3), ("NEW_CAMPAIGN", len(s["first"]) <= 2)):
            if holds and kind not in s["holding"]:
                s["n"] += 1
                s["open"][f"alr-{campaign}-{s['n']:04d}"] = kind
                out.append((campaign, f"alr-{campaign}-{s['n']:04d}", kind, ts))
            s["holding"] = s["holding"] | {kind} if holds else s["holding"] - {kind}
    return out, {(c, a, k) for c, s in state.items() for a, k in s["open"].items()}


def test_alerts_equal_a_fold_across_restarts(spark, tmp_path):
    rng = random.Random(1)
    posts = [(k, rng.randrange(4), rng.randrange(12), rng.choice("abcd"), float(rng.randrange(30)), START + timedelta(hours=k)) for k in range(150)]
    raised, _ = fold(posts, [])
    acks = [(1000 + k, c, a, ts + timedelta(minutes=1)) for k, (c, a, _, ts) in enumerate(raised[::2])] + [(2000, 1, "alr-1-9999", START)]
    cut = [START + timedelta(hours=60), START + timedelta(hours=61)]
    between = lambda rows, c, a, b: [r for r in rows if a <= r[c] < b]
    edges = [START, *cut, START + timedelta(days=99)]
    parts = [[("posts", between(posts, 5, a, b), POST), ("acks", between(acks, 3, a, b), ACK)] for a, b in zip(edges, edges[1:])]

    def make():
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        return K.alert_states(read("posts", POST), read("acks", ACK), {"estimated_reach": 500})

    for name in ("posts", "acks"):
        (tmp_path / name).mkdir()
    changes = drained(spark, make, tmp_path, parts, tmp_path / "out")
    want, still_open = fold(posts, acks)
    got = changes.where("event = 'RAISED'").select("campaign", "alert_id", "alert_type", "ts").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({k for _, _, k, _ in want}) == 4
    assert {tuple(r) for r in K.open_alerts(changes).select("campaign", "alert_id", "alert_type").collect()} == still_open
    assert {r["event"]: r["count"] for r in changes.groupBy("event").count().collect()}["UNKNOWN"] == 1


def test_spread_is_kept_across_batches_and_closed_by_a_timer(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, k % 3, START + timedelta(hours=k), rng.choice("abc"), k % 7, k) for k in range(60)]
    late = [(100, 0, START + timedelta(hours=59, minutes=30), "z", 9, 1)]
    quiet = [(200, 5, START + timedelta(days=60), "q", 1, 1)]  # moves the watermark beyond the others' timers
    (tmp_path / "seen").mkdir()
    make = lambda: K.spread_states(spark.readStream.schema(SEEN).parquet(f"{tmp_path}/seen"), idle="10 days")
    parts = [[("seen", rows[:25], SEEN)], [("seen", rows[25:] + late, SEEN)], [("seen", quiet, SEEN)]]
    changes = drained(spark, make, tmp_path, parts, tmp_path / "out")
    got = {r["image"]: r for r in K.latest(changes, "image").collect()}
    for image in range(3):
        mine = [r for r in rows + late if r[1] == image]
        r = got[image]
        assert (r["n"], r["platforms"], r["reach"], r["first_platform"], r["first_channel"]) == (len(mine), len({m[3] for m in mine}), sum(m[5] for m in mine), mine[0][3], mine[0][4])
        assert r["closed"] and (r["first_ts"], r["last_ts"]) == (min(m[2] for m in mine), max(m[2] for m in mine))
    assert not got[5]["closed"]
    score = {r["image"]: r["score"] for r in K.spread_map(changes).collect()}
    assert score[5] == 18.0 and changes.where(F.col("image") == 0).count() >= 3
