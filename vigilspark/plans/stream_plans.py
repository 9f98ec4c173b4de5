"""Streaming queries, drained with a checkpoint; rows only, tests hold them against batch versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.plans.intel_plans import APPEAR
from vigilspark.streaming import monitor as M
from vigilspark.streaming import stateful as K

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query("SELECT user_id, event_type, count(*) AS kept FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_dedup(spark, sf_dir):
    """One post of each (channel, type) in the stream's lifetime (ST-5); which one is the order of arrival."""
    posts = M.events(spark, sf_dir).withColumn("url_hash", F.xxhash64("user_id", "event_type"))
    kept = M.run_available(M.first_seen(posts), "stream_dedup")
    return kept.groupBy("user_id", "event_type").agg(F.count("*").alias("kept"))


@query()
def rolling_growth_stream(spark, sf_dir):
    return M.drain_growth(M.events(spark, sf_dir), "rolling_growth")


@query()
def early_warning_stream(spark, sf_dir):
    return M.run_available(M.window_alerts(M.events(spark, sf_dir), thresholds={"estimated_reach": 100}), "early_warning")


@query()
def spread_stream(spark, sf_dir):
    return M.run_available(M.spread(M.events(spark, sf_dir).withColumn("image", F.col("user_id") % 40)), "spread")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE user_id IN (SELECT s_suppkey FROM supplier)")
def watchlist_stream(spark, sf_dir):
    watched = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("user_id"))
    return M.run_available(M.watchlist(M.events(spark, sf_dir), watched), "watchlist").select("event_id", "user_id", "event_type", "value")


@query(f"""WITH {APPEAR}, g AS (SELECT image, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS h, CAST(count(DISTINCT platform) AS INTEGER) AS platforms, CAST(sum(reach) AS BIGINT) AS reach, arg_min(platform, (ts, id)) AS first_platform, arg_min(channel, (ts, id)) AS first_channel FROM app GROUP BY 1)
  SELECT image, n, platforms, reach, first_platform, first_channel, CASE WHEN n < 2 THEN 0.0 ELSE round(n / greatest(1.0, h), 4) END AS velocity, round(least(100.0, n * 3 + platforms * 15 + least(30.0, reach / 1000)), 2) AS score FROM g""")
def spread_state_stream(spark, sf_dir):
    """Spread of each image kept as keyed state across batches (ST-11, AG-22)."""
    e = M.events(spark, sf_dir)
    appear = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("image"), "ts", F.col("event_type").alias("platform"), F.col("user_id").alias("channel"), F.floor(F.col("value") * 10).alias("reach"))
    return K.spread_map(M.run_available(K.spread_states(appear, idle="3650 days", late="3650 days"), "spread_states"))


@query("""WITH p AS (SELECT event_id AS id, user_id % 50 AS campaign, user_id AS channel, event_type AS platform, value AS reach, ts FROM events),
  f AS (SELECT *, row_number() OVER (PARTITION BY campaign, channel ORDER BY ts, id) = 1 AS fresh, row_number() OVER (PARTITION BY campaign, platform ORDER BY ts, id) = 1 AS newly FROM p),
  r AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER w AS channels, sum(CAST(newly AS INTEGER)) OVER w AS platforms, sum(reach) OVER w AS total, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY campaign ORDER BY ts, id)),
  c AS (SELECT r.campaign, r.n, r.ts, r.channels, r.platforms, r.total, (SELECT count(*) FROM f WHERE f.campaign = r.campaign AND f.fresh AND (f.ts, f.id) <= (r.ts, r.id) AND epoch_ms(f.ts) > epoch_ms(r.ts) - 86400000) AS fresh FROM r),
  l AS (SELECT campaign, n, ts, unnest([{'t': 'RAPID_GROWTH', 's': 'CRITICAL', 'h': fresh >= 5, 'v': fresh::DOUBLE, 'o': 1}, {'t': 'HIGH_VICTIM_RISK', 's': 'CRITICAL', 'h': total >= 10000, 'v': total::DOUBLE, 'o': 2},
    {'t': 'CROSS_PLATFORM', 's': 'EMERGENCY', 'h': platforms >= 3, 'v': platforms::DOUBLE, 'o': 3}, {'t': 'NEW_CAMPAIGN', 's': 'WATCH', 'h': channels <= 2, 'v': channels::DOUBLE, 'o': 4}]) AS x FROM c),
  e AS (SELECT *, lag(x.h) OVER (PARTITION BY campaign, x.t ORDER BY n) AS before FROM l)
  SELECT campaign, 'alr-' || campaign || '-' || lpad(CAST(row_number() OVER (PARTITION BY campaign ORDER BY n, x.o) AS VARCHAR), 4, '0') AS alert_id, x.t AS alert_type, x.s AS severity, ts, round(x.v, 2) AS value
  FROM e WHERE x.h AND NOT coalesce(before, false)""")
def alert_state_stream(spark, sf_dir):
    """Alerts of campaigns raised from keyed state, with counted ids (ST-7, ST-8)."""
    e = M.events(spark, sf_dir)
    posts = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("campaign"), F.col("user_id").alias("channel"), F.col("event_type").alias("platform"), F.col("value").alias("reach"), "ts")
    changes = M.run_available(K.alert_states(posts), "alert_states")
    return K.open_alerts(changes).withColumn("value", F.round("value", 2))
