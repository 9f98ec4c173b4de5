"""Behavioural features of channels from their posts (AG-9..16, AG-31..41, AG-55, WN-1, DM-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilspark.functions.scores import entropy
from vigilspark.operators.scan import with_previous


def bins(df: DataFrame, key: str, index, n: int, name: str) -> DataFrame:
    """Counts of ``index`` 0..n-1 by key as one array, empty bins included: one pass, no spine join."""
    counts = df.groupBy(key).agg(*[F.count_if(index == i).alias(f"b{i}") for i in range(n)])
    return counts.select(key, F.array(*[F.col(f"b{i}").cast("double") for i in range(n)]).alias(name))


def posting_schedule(posts: DataFrame) -> DataFrame:
    """24 hour shares of each channel (AG-9) with their entropy (AG-40) and peak hour (AG-41)."""
    hours = bins(posts.where("ts is not null"), "channel", F.hour("ts"), 24, "hours")
    total = F.aggregate("hours", F.lit(0.0), lambda s, x: s + x)
    peak = _peak(F.col("hours"))
    shares = F.transform("hours", lambda x: F.when(total > 0, F.round(x / total, 6)).otherwise(F.lit(0.0)))
    return hours.select("channel", shares.alias("schedule"), entropy(F.col("hours")).alias("hours_entropy"), peak.alias("peak_hour"))


def day_entropy(posts: DataFrame) -> DataFrame:
    days = bins(posts.where("ts is not null"), "channel", F.weekday("ts"), 7, "days")
    return days.select("channel", entropy(F.col("days")).alias("days_entropy"))


def daily_rhythm(posts: DataFrame) -> DataFrame:
    """Mean and population deviation of posts a day, regularity, frequency over the span (AG-10, AG-14, AG-16, AG-31)."""
    return rhythm_of(hourly_counts(posts))


def rhythm_of(hourly: DataFrame) -> DataFrame:
    """The rhythm from hourly counts, which are far fewer than posts."""
    daily = hourly.groupBy("channel", F.to_date("h").alias("day")).agg(F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    grouped = daily.groupBy("channel").agg(
        F.avg("n").alias("m"), F.stddev_pop("n").alias("sd"), F.count("*").alias("days"), F.sum("n").alias("posts"), F.min("t0").alias("t0"), F.max("t1").alias("t1")
    )
    seconds = F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))
    span = F.floor(seconds / 86_400_000_000)
    regular = F.when(F.col("days") < 2, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.greatest("m", F.lit(1e-6))), 4))
    return grouped.select(
        "channel", F.col("posts").cast("long").alias("posts"), F.round("m", 2).alias("posts_per_day_mean"), F.round("sd", 2).alias("posts_per_day_std"),
        regular.alias("regularity"), F.when(F.col("posts") < 2, F.lit(0)).otherwise(F.greatest(F.lit(1), span)).cast("long").alias("observation_days"),
        F.round(F.col("posts") / F.greatest(F.lit(1), span), 2).alias("posting_frequency"),
    )


def burst(posts: DataFrame) -> DataFrame:
    """Largest hourly count over the mean of non-empty hours, at least 1 (AG-15)."""
    return burst_of(hourly_counts(posts))


def burst_of(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("channel").agg(F.round(F.max("n") / F.greatest(F.avg("n"), F.lit(1.0)), 2).alias("burst"))


def silence(posts: DataFrame) -> DataFrame:
    """Longest gap between consecutive posts in hours, capped at 720, as a share of 720 (WN-1); a busy channel is split among tasks."""
    timed = posts.where("ts is not null").select("channel", "message_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    gaps = with_previous(timed, ["channel"], ["t", "message_id"], {"before": "t"})
    gap = ((F.col("t") - F.col("before")) / 3_600_000_000).alias("gap")
    return gaps.select("channel", gap).groupBy("channel").agg(F.round(F.least(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(720.0)) / 720, 4).alias("silence"))


def _counter_columns() -> list[Column]:
    n, ids = F.count("*"), F.count(F.nullif("message_id", F.lit(0)))
    span = F.max(F.nullif("message_id", F.lit(0))) - F.min(F.nullif("message_id", F.lit(0))) + 1
    views = F.when(F.col("views") == 0, F.lit(1)).otherwise(F.col("views"))
    engaged = F.avg((F.col("reactions") + F.col("forwards") + F.col("replies")) / views)
    return [
        F.when(ids < 2, F.lit(0.0)).otherwise(F.round(1 - ids / span, 4)).alias("deletion_rate"),
        F.round(engaged, 6).alias("engagement"),
        F.round(F.avg(F.when(F.col("views") > 0, F.col("views"))), 4).alias("mean_views"),
        F.round(100 * F.count_if(F.col("media") == "images") / n, 2).alias("images_per_100"),
        F.round(100 * F.count_if(F.col("media") == "videos") / n, 2).alias("videos_per_100"),
        F.round(100 * F.count_if(F.col("media") == "links") / n, 2).alias("links_per_100"),
        F.round(F.avg("forwards"), 3).alias("forward_ratio"),
    ]


def counters(posts: DataFrame) -> DataFrame:
    """Deletion rate, engagement, view share and media ratios in one aggregation (AG-12, AG-32, AG-37, AG-38)."""
    return posts.groupBy("channel").agg(*_counter_columns())


def one_pass(posts: DataFrame) -> DataFrame:
    """Counters, hour entropy and peak, and day entropy of each channel from a single aggregation."""
    hour, day = F.hour("ts"), F.weekday("ts")
    binned = [F.count_if(hour == i).cast("double").alias(f"h{i}") for i in range(24)] + [F.count_if(day == i).cast("double").alias(f"d{i}") for i in range(7)]
    g = posts.groupBy("channel").agg(*binned, *_counter_columns())
    g = g.withColumns({"hours": F.array(*[F.col(f"h{i}") for i in range(24)]), "days": F.array(*[F.col(f"d{i}") for i in range(7)])})
    kept = [c for c in g.columns if not c[1:].isdigit() and c not in ("hours", "days")]
    return g.select(*kept, entropy(F.col("hours")).alias("hours_entropy"), entropy(F.col("days")).alias("days_entropy"), _peak(F.col("hours")).alias("peak_hour"))


def _peak(hours: Column) -> Column:
    total = F.aggregate(hours, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, (F.array_position(hours, F.array_max(hours)) - 1).cast("double")).otherwise(F.lit(12.0))


def hourly_counts(posts: DataFrame) -> DataFrame:
    """(channel, h, n, t0, t1): the common base of bursts and daily rhythm."""
    return posts.where("ts is not null").groupBy("channel", F.date_trunc("hour", "ts").alias("h")).agg(
        F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1")
    )


def growth_per_day(snapshots: DataFrame) -> DataFrame:
    """Subscribers gained a day between first and last snapshot, at least one day apart (AG-55, WN-16)."""
    ends = snapshots.groupBy("channel").agg(
        F.min_by("subscribers", "date").alias("s0"), F.max_by("subscribers", "date").alias("s1"), F.min("date").alias("d0"), F.max("date").alias("d1"), F.count("*").alias("n")
    )
    days = F.greatest((F.unix_micros(F.col("d1").cast("timestamp")) - F.unix_micros(F.col("d0").cast("timestamp"))) / 86_400_000_000, F.lit(1.0))
    return ends.select("channel", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.round((F.col("s1") - F.col("s0")) / days, 2)).alias("growth_rate"))


def text_features(texts: DataFrame, urgency: list[str], backup: list[str], emoji: str, first: int | None = None) -> DataFrame:
    """Urgency, backup, emoji and length figures of a channel's texts (AG-33..36); ``first`` keeps the first posts of a channel."""
    from vigilspark.functions.text import any_word, emoji_runs, word_hits

    if first:
        w = W.partitionBy("channel").orderBy("message_id")
        texts = texts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first).drop("_n")
    t = F.coalesce("text", F.lit(""))
    chars = F.sum(F.length(t))
    # one search for the words serves density and share
    return texts.withColumn("_hits", word_hits(t, urgency)).groupBy("channel").agg(
        F.count("*").alias("n_texts"),
        F.round(F.sum("_hits") / F.count("*") * 100, 2).alias("urgency_density"),
        F.round(F.avg((F.col("_hits") > 0).cast("int")), 4).alias("urgency_share"),
        F.count_if(any_word(t, backup)).alias("backup_mentions"),
        F.coalesce(F.round(F.sum(emoji_runs(t, emoji)) / F.nullif(chars, F.lit(0)) * 100, 4), F.lit(0.0)).alias("emoji_density"),
        F.coalesce(F.round(F.avg(F.when(t != "", F.length(t))), 4), F.lit(0.0)).alias("avg_length"),
    )


def entity_counts(channel_entities: DataFrame) -> DataFrame:
    """Distinct contact points by type and the share of the four payment kinds in use (AG-13, AG-39).

    Payment kinds are payment addresses, phones, mentions of payment codes (type QR)
    and addresses of pages that name a crypto currency.
    """
    from vigilspark.functions import fixed as X

    crypto = F.col("value").rlike("(?i)" + "|".join(X.CRYPTO_WORDS))
    kinds = channel_entities.groupBy("channel").agg(
        *[F.count_if(F.col("entity_type") == k).alias(f"{k.lower()}s") for k in ("UPI", "PHONE", "URL", "QR")],
        F.count_if((F.col("entity_type") == "URL") & crypto).alias("cryptos"),
    )
    used = [(F.col(c) > 0).cast("int") for c in ("upis", "phones", "qrs", "cryptos")]
    return kinds.withColumn("payment_diversity", (used[0] + used[1] + used[2] + used[3]) / 4)


def language_shares(texts: DataFrame) -> DataFrame:
    """Share of texts of a channel in each detected language, in one aggregation (AG-11)."""
    from vigilspark.functions.text import script_language

    spoken = texts.select("channel", script_language(F.coalesce("text", F.lit(""))).alias("language"))
    return spoken.groupBy("channel").agg(
        *[F.round(F.count_if(F.col("language") == k) / F.count("*"), 3).alias(f"{k}_share") for k in ("hindi", "english", "hinglish")]
    )


def mentions(texts: DataFrame) -> DataFrame:
    """Distinct channels that a channel's texts link to, and mentions of payment codes for 100 texts (DM-16)."""
    from vigilspark.functions.text import code_mentions, telegram_links

    t = F.coalesce("text", F.lit(""))
    links = texts.select("channel", F.explode(telegram_links(t)).alias("link")).distinct().groupBy("channel").agg(F.count("*").alias("linked_channels"))
    codes = texts.groupBy("channel").agg(F.round(F.sum(code_mentions(t)) / F.count("*") * 100, 4).alias("qr_per_100"))
    return codes.join(links, "channel", "left")


def fingerprint(posts: DataFrame, texts: DataFrame, channel_entities: DataFrame, snapshots: DataFrame) -> DataFrame:
    """28 features of each channel that posts (DM-16); parts that a channel lacks count as 0.

    ``snapshots``: (channel, date, subscribers); the last one is the number of
    subscribers that views are compared with.

    Three passes over the posts: one aggregation by channel, one by channel and
    hour that bursts and daily rhythm share, one ordered pass for gaps. Every part
    is an aggregate by channel, so the joins meet one row for each channel;
    channels partitioned once stay so through the whole chain.
    """
    from vigilspark.functions import fixed as X

    hourly = hourly_counts(posts)
    parts = [
        one_pass(posts), rhythm_of(hourly), burst_of(hourly), silence(posts),
        text_features(texts, X.URGENCY_FULL, X.BACKUP_FULL, X.EMOJI), entity_counts(channel_entities), language_shares(texts), mentions(texts),
        growth_per_day(snapshots), snapshots.groupBy("channel").agg(F.max_by("subscribers", "date").alias("subscribers")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.join(part, "channel", "left")
    c = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    seen_by = F.when(c("subscribers") > 0, F.least(c("mean_views") / c("subscribers"), F.lit(5.0))).otherwise(F.lit(0.0))
    vector = [
        c("hours_entropy"), c("days_entropy"), c("posts_per_day_mean"), c("posts_per_day_std"), c("burst"), c("silence"), c("peak_hour") / 24, c("regularity"),
        c("hindi_share"), c("english_share"), c("hinglish_share"), c("avg_length") / 1000, c("urgency_density"), c("emoji_density"),
        c("forward_ratio"), (c("images_per_100") + c("videos_per_100")) / 100, c("links_per_100") / 100, c("linked_channels") / 50,
        c("backup_mentions") / 10, c("deletion_rate"),
        c("upis") / 20, c("phones") / 20, c("urls") / 50, c("qr_per_100"), c("payment_diversity"),
        F.least(c("growth_rate") / 100, F.lit(1.0)), seen_by, c("engagement"),
    ]
    return whole.select("channel", F.transform(F.array(*vector), lambda x: F.round(x, 4)).alias("vector"))
