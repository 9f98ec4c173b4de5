"""Keyed state with timers: the spread of images and the alerts of campaigns (ST-7, ST-8, ST-11).

Each processor keeps a few state variables a key and answers with change rows, which
a file sink can append; :func:`latest` reads the present state from them.  Rows of a
key are taken in the order of their time within a micro-batch, so any cut of an
ordered stream into batches, also by a restart, gives the same states.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilspark.functions import fixed as X

#: State stores that state variables and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
DAY_MS = 86_400_000


def with_store(df: DataFrame) -> DataFrame:
    """The session keeps states in RocksDB, which state variables need; streams that run already keep theirs."""
    df.sparkSession.conf.set(*STORE)
    return df


def _ms(t: datetime) -> int:
    return int(t.timestamp() * 1000)


SPREAD = (
    "image long, version long, n long, platforms int, reach long, first_platform string, first_channel long, first_ts timestamp, last_ts timestamp, closed boolean"
)


class Spread(StatefulProcessor):
    """First platform, span, reach and platforms of each image; an image unseen for ``idle_ms`` is closed and forgotten."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "version long, n long, reach long, first_ms long, first_id long, platform string, channel long, last_ms long, timer long")
        self.platforms = handle.getMapState("platforms", "platform string", "seen boolean")

    def _row(self, key: tuple, facts: tuple, closed: bool) -> Row:
        version, n, reach, first, _, platform, channel, last, _ = facts
        count = sum(1 for _ in self.platforms.keys())
        at = lambda ms: datetime.fromtimestamp(ms / 1000)
        return Row(
            image=key[0], version=version, n=n, platforms=count, reach=reach, first_platform=platform, first_channel=channel, first_ts=at(first), last_ts=at(last), closed=closed
        )

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        seen = [(_ms(r["ts"]), r["id"], r["platform"], r["channel"], r["reach"]) for r in rows if r["ts"] is not None]
        if not seen:
            return
        first, last = min(seen), max(seen)
        version, n, reach, begun, begun_id, platform, channel, latest, timer = self.facts.get() if self.facts.exists() else (0, 0, 0, *first[:4], first[0], 0)
        if first[:2] < (begun, begun_id):
            begun, begun_id, platform, channel = first[:4]
        latest = max(latest, last[0])
        for name in {p for _, _, p, _, _ in seen}:
            if not self.platforms.containsKey((name,)):
                self.platforms.updateValue((name,), (True,))
        if timer:
            self.handle.deleteTimer(timer)
        timer = latest + self.idle_ms
        self.handle.registerTimer(timer)
        facts = (version + 1, n + len(seen), reach + sum(x for *_, x in seen), begun, begun_id, platform, channel, latest, timer)
        self.facts.update(facts)
        yield self._row(key, facts, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.facts.exists():
            facts = self.facts.get()
            yield self._row(key, (facts[0] + 1, *facts[1:]), True)
            self.facts.clear()
            self.platforms.clear()

    def close(self) -> None:
        pass


def spread_states(appearances: DataFrame, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """Changes of the spread of each image: (image, version, n, platforms, reach, first_platform, first_channel, first_ts, last_ts, closed).

    ``appearances``: stream of (id, image, ts, platform, channel, reach).  The first
    appearance is the earliest by (ts, id), however late it comes within the watermark.
    """
    idle_ms = appearances.sparkSession.range(1).select(F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {idle}"))).first()[0]
    keyed = with_store(appearances).select(
        F.col("id").cast("long"), F.col("image").cast("long"), "ts", F.coalesce(F.col("platform"), F.lit("")).alias("platform"), F.col("channel").cast("long"),
        F.coalesce(F.col("reach").cast("long"), F.lit(0)).alias("reach"),
    )
    return keyed.withWatermark("ts", late).groupBy("image").transformWithState(Spread(idle_ms), SPREAD, "Append", "EventTime")


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key; small states, pre-aggregated."""
    rest = [c for c in changes.columns if c not in keys]
    top = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("s"))
    return top.select(*keys, "s.*")


def spread_map(changes: DataFrame) -> DataFrame:
    """Velocity and score of each image from its last state, as :func:`vigilspark.operators.intel.viral_spread` has them of all appearances."""
    hours = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 3_600_000_000
    return latest(changes, "image").select(
        "image", "n", F.col("platforms"), "reach", "first_platform", "first_channel",
        F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.round(F.col("n") / F.greatest(F.lit(1.0), hours), 4)).alias("velocity"),
        F.round(F.least(F.lit(100.0), F.col("n") * 3 + F.col("platforms") * 15 + F.least(F.lit(30.0), F.col("reach") / 1000)), 2).alias("score"),
    )


ALERT = "campaign long, version long, alert_id string, alert_type string, severity string, event string, ts timestamp, value double"


class Alerts(StatefulProcessor):
    """Alerts of a campaign with counted ids; acknowledgements take them away.

    A condition raises an alert when it begins to hold, and again once it has
    stopped.  New channels are those first seen within the 24 hours before a post.
    """

    def __init__(self, thresholds: dict) -> None:
        self.t = thresholds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "version long, counter long, channels long, reach double")
        self.recent = handle.getMapState("recent", "channel long", "first_ms long")
        self.platforms = handle.getMapState("platforms", "platform string", "seen boolean")
        self.active = handle.getMapState("active", "alert_id string", "alert_type string")
        self.holding = handle.getMapState("holding", "alert_type string", "since_ms long")

    def _conditions(self, channels: int, fresh: int, reach: float, platforms: int) -> list[tuple[str, str, bool, float]]:
        return [
            ("RAPID_GROWTH", "CRITICAL", fresh >= self.t["new_channels_24h"], float(fresh)),
            ("HIGH_VICTIM_RISK", "CRITICAL", reach >= self.t["estimated_reach"], float(reach)),
            ("CROSS_PLATFORM", "EMERGENCY", platforms >= self.t["platforms"], float(platforms)),
            ("NEW_CAMPAIGN", "WATCH", 0 < channels <= 2, float(channels)),
        ]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        version, counter, channels, reach = self.facts.get() if self.facts.exists() else (0, 0, 0, 0.0)
        first = {k[0]: v[0] for k, v in self.recent.iterator()}
        platforms = {k[0] for k in self.platforms.keys()}
        holding = {k[0]: v[0] for k, v in self.holding.iterator()}
        active = {k[0]: v[0] for k, v in self.active.iterator()}
        kept = (dict(first), set(platforms), dict(holding), dict(active))
        begun = sorted(first.values())  # so that a post costs a search and not a pass over all channels
        made = []
        for row in sorted(rows, key=lambda r: (r["ts"], r["id"])):
            now = _ms(row["ts"])
            if row["alert_id"] is not None:
                known = active.pop(row["alert_id"], None)
                version += 1
                made.append((version, row["alert_id"], known, None, "ACKNOWLEDGED" if known else "UNKNOWN", row["ts"], None))
                continue
            if row["channel"] is not None and row["channel"] not in first:
                first[row["channel"]], channels = now, channels + 1
                insort(begun, now)
            if row["platform"] is not None:
                platforms.add(row["platform"])
            reach += row["reach"] or 0.0
            fresh = len(begun) - bisect_right(begun, now - DAY_MS)
            for kind, severity, holds, value in self._conditions(channels, fresh, reach, len(platforms)):
                if not holds:
                    holding.pop(kind, None)
                elif kind not in holding:
                    holding[kind], counter, version = now, counter + 1, version + 1
                    name = f"alr-{key[0]}-{counter:04d}"
                    active[name] = kind
                    made.append((version, name, kind, severity, "RAISED", row["ts"], value))
        self.facts.update((version, counter, channels, reach))
        for state, now, before in ((self.recent, first, kept[0]), (self.platforms, dict.fromkeys(platforms, True), dict.fromkeys(kept[1], True)), (self.holding, holding, kept[2]), (self.active, active, kept[3])):
            for k in before.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if before.get(k) != v:
                    state.updateValue((k,), (v,))
        for v, alert_id, kind, severity, event, ts, value in made:
            yield Row(campaign=key[0], version=v, alert_id=alert_id, alert_type=kind, severity=severity, event=event, ts=ts, value=value)

    def close(self) -> None:
        pass


def alert_states(posts: DataFrame, acknowledged: DataFrame | None = None, thresholds: dict | None = None) -> DataFrame:
    """Alerts of campaigns as they are raised and acknowledged: (campaign, version, alert_id, alert_type, severity, event, ts, value).

    ``posts``: stream of (id, campaign, channel, platform, reach, ts); ``acknowledged``:
    stream of (id, campaign, alert_id, ts).  Alert ids count within their campaign, so
    no counter is shared by all of them.  The state of a campaign holds its channels,
    platforms and open alerts.
    """
    rows = with_store(posts).select(
        F.col("id").cast("long"), F.col("campaign").cast("long"), F.col("channel").cast("long"), "platform", F.col("reach").cast("double"), "ts", F.lit(None).cast("string").alias("alert_id")
    )
    if acknowledged is not None:
        rows = rows.unionByName(acknowledged.select(F.col("id").cast("long"), F.col("campaign").cast("long"), "alert_id", "ts"), allowMissingColumns=True)
    return rows.where("ts is not null and campaign is not null").groupBy("campaign").transformWithState(Alerts(X.ALERT_THRESHOLDS | (thresholds or {})), ALERT, "Append", "None")


def open_alerts(changes: DataFrame) -> DataFrame:
    """Alerts that were raised and not acknowledged since."""
    last = latest(changes.where("event <> 'UNKNOWN'"), "campaign", "alert_id")
    return last.where("event = 'RAISED'").select("campaign", "alert_id", "alert_type", "severity", "ts", "value")


