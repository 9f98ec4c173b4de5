"""The twenty inputs of the decision score, from posts, texts, lists and results about a channel (DM-11a to d)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import text as T
from vigilspark.operators.linking import shared_counts
from vigilspark.operators.patterns import contained
from vigilspark.storage import materialize

COUNTS = ["xref_hits", "domain_hits", "upis", "phones", "linked", "connections", "campaigns", "overlap", "backup"]
SHARES = ["forward_ratio", "similarity", "subscribers", "urgency_pct", "deletion_rate", "confidence", "image_pct", "hinglish"]
FLAGS = ["bad_tld", "has_qr"]


def collected(texts: DataFrame) -> DataFrame:
    """(channel, entity_type, value), distinct: entities of the texts (channel, message_id, text) of channels (SF-15, SC-17).

    A mention of a payment code is an entity of type QR, named by its message.
    """
    code = F.struct(F.lit("QR").alias("entity_type"), F.concat(F.lit("msg_"), F.coalesce(F.col("message_id").cast("string"), F.lit(""))).alias("value"))
    every = F.concat(T.collected_entities(F.col("text")), F.array_compact(F.array(F.when(T.shows_code(F.col("text")), code))))
    return texts.select("channel", F.explode(every).alias("e")).select("channel", "e.entity_type", "e.value").distinct()


def linked_channels(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(channel, linked), distinct: names of the channels that a channel links to, its own name (``names``: channel, name) left out."""
    named = entities.where("entity_type = 'TELEGRAM'").select("channel", T.linked_name(F.col("value")).alias("linked")).where("linked <> ''").distinct()
    own = names.where("name is not null").select("channel", F.col("name").alias("linked")).distinct()
    return named.join(own, ["channel", "linked"], "left_anti")


def schedule_similarity(posts: DataFrame, known: DataFrame) -> DataFrame:
    """(channel, similarity): cosine of a channel's posts by hour of the week with those of all ``known`` (channel) together.

    Counts by channel and hour come first, so a busy channel is at most 168 rows;
    channels without dated posts have no row, and without known channels none has.
    """
    hour = (F.weekday("ts") * 24 + F.hour("ts")).alias("h")
    held = posts.where("ts is not null").groupBy("channel", hour).agg(F.count("*").cast("double").alias("n"))
    profile = held.join(known.select("channel").distinct(), "channel", "left_semi").groupBy("h").agg(F.sum("n").alias("m"))  # at most 168 rows
    length = F.broadcast(profile.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length")).where("length > 0"))
    dots = held.join(F.broadcast(profile), "h", "left").groupBy("channel").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("own"))
    return dots.join(length, F.lit(True)).select("channel", F.round(F.col("dot") / (F.col("own") * F.col("length")), 6).alias("similarity"))


def rule_confidence(texts: DataFrame) -> DataFrame:
    """(channel, confidence): the share of a channel's texts that the rules give a category, by two hits of its patterns; null texts have none."""
    low = F.lower("text")
    best = F.greatest(*[reduce(lambda a, b: a + b, [T.matches(low, p).cast("int") for p in patterns]) for _, patterns in X.RULE_PATTERNS])
    return texts.groupBy("channel").agg(F.avg(F.coalesce((best >= 2).cast("int"), F.lit(0))).alias("confidence"))


def _of_entities(entities: DataFrame, linked: DataFrame, blocked: DataFrame, domains: DataFrame, first_urls: int) -> list[DataFrame]:
    n = F.count("*")
    urls = entities.where("entity_type = 'URL'").select("channel", "value")
    listed = blocked.where("value is not null").select("entity_type", "value").distinct()
    of_kind = lambda kind: listed.where(F.col("entity_type") == kind).select("value")
    by_url = urls.join(of_kind("URL"), "value", "left_semi").groupBy("channel").agg(n.alias("url_hits"))
    by_link = linked.withColumnRenamed("linked", "value").join(of_kind("CHANNEL"), "value", "left_semi").groupBy("channel").agg(n.alias("channel_hits"))
    found = contained(urls.select(F.col("value").alias("id"), F.col("value").alias("text")).distinct(), domains.select(F.col("domain").alias("pattern")))
    hits = found.groupBy(F.col("id").alias("value")).agg(n.alias("matches"))
    by_domain = urls.join(hits, "value").groupBy("channel").agg(n.alias("domain_hits"), F.sum("matches").alias("domain_matches"))
    kinds = entities.groupBy("channel").agg(
        F.count_if(F.col("entity_type") == "UPI").alias("upis"), F.count_if(F.col("entity_type") == "PHONE").alias("phones"), (F.count_if(F.col("entity_type") == "QR") > 0).alias("has_qr")
    )
    head = urls.withColumn("nth", F.row_number().over(W.partitionBy("channel").orderBy("value"))).where(F.col("nth") <= first_urls)
    tld = reduce(lambda a, b: a | b, [F.lower("value").contains(t) for t in X.DECISION_TLDS])
    bad = head.groupBy("channel").agg(F.max(tld).alias("bad_tld"))
    links = linked.groupBy("channel").agg(n.alias("linked"))
    shared = entities.where("entity_type <> 'QR'")
    connections = shared.join(shared_counts(shared), ["entity_type", "value"]).groupBy("channel").agg(n.alias("connections"))
    return [by_url, by_link, by_domain, kinds, bad, links, connections]


def _of_posts(posts: DataFrame, texts: DataFrame, first: int) -> list[DataFrame]:
    n = F.count("*")
    numbered = F.nullif("message_id", F.lit(0))
    counters = posts.groupBy("channel").agg(
        F.round(F.count_if(F.col("forwards") > 0) / n, 3).alias("forward_ratio"), F.round(F.count_if(F.col("media") == "images") / n * 100, 2).alias("image_pct"),
        F.when(F.count(numbered) >= 2, 1 - F.count(numbered) / (F.max(numbered) - F.min(numbered) + 1)).otherwise(0.0).alias("deletion_rate"),
    )
    t = F.col("text")
    head = texts.withColumn("nth", F.row_number().over(W.partitionBy("channel").orderBy("message_id", "text"))).where(F.col("nth") <= first)
    pressed = head.groupBy("channel").agg(
        (F.count_if(T.any_word(t, X.URGENCY_DECISION)) / n * 100).alias("urgency_pct"), F.count_if(T.any_word(t, X.BACKUP_DECISION)).alias("backup")
    )
    spoken = texts.where(F.trim("text") != "").groupBy("channel").agg(F.round(F.count_if(T.script_language(t) == "hinglish") / n, 3).alias("hinglish"))
    return [counters, pressed, spoken]


def decision_signals(
    posts: DataFrame, texts: DataFrame, names: DataFrame, blocked: DataFrame, domains: DataFrame, snapshots: DataFrame,
    similarity: DataFrame, classified: DataFrame, campaigns: DataFrame, first_texts: int = 100, first_urls: int = 10, entities: DataFrame | None = None,
) -> DataFrame:
    """One row per channel with the inputs of :func:`intel.decision_score`; what a channel lacks counts as 0.

    ``posts`` (channel, message_id, forwards, media); ``texts`` (channel, message_id, text);
    ``names`` (channel, name); ``blocked`` (entity_type URL or CHANNEL, value); ``domains`` (domain),
    matched as substrings of addresses; ``snapshots`` (channel, date, subscribers), the last one counts;
    ``similarity`` (channel, similarity) with known frauds; ``classified`` (channel, confidence);
    ``campaigns`` (channel, campaign); ``entities`` of :func:`collected` if they are written already.  Channels are those that post, tell something, or have a name.

    Cross-reference hits are exact matches of addresses and linked channels; the overlap
    adds every (address, domain) match.  The first texts go by message number, the first
    addresses by value, as the collector sorts them.  Every part is an aggregate by channel,
    so the parts meet as one row each in a single shuffle; ranks are cut before theirs.
    """
    entities = materialize(collected(texts)) if entities is None else entities  # eight parts read it
    linked = linked_channels(entities, names)
    parts = _of_entities(entities, linked, blocked, domains, first_urls) + _of_posts(posts, texts, first_texts) + [
        snapshots.groupBy("channel").agg(F.max_by("subscribers", F.struct("date", "subscribers")).cast("double").alias("subscribers")),
        similarity.groupBy("channel").agg(F.max("similarity").alias("similarity")),
        classified.groupBy("channel").agg(F.max("confidence").alias("confidence")),
        campaigns.groupBy("channel").agg(F.count_distinct("campaign").alias("campaigns")),
        names.select("channel").distinct(),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).where("channel is not null")
    one = rows.groupBy("channel").agg(*[F.max(c).alias(c) for c in rows.columns if c != "channel"])
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long")
    xref = count("url_hits") + count("channel_hits")
    one = one.withColumns({"xref_hits": xref, "overlap": xref + count("domain_matches")})
    return one.select(
        "channel", *[count(c).alias(c) for c in COUNTS], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in SHARES],
        *[F.coalesce(c, F.lit(False)).alias(c) for c in FLAGS],
    )
