"""Evidence, confidence, recommendation, decision scores, roles, graph and growth figures (DM-*, GR-*, AG-22/25/26/52)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import scores as S


def strength_rank(strength: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in X.STRENGTH_RANK for x in p])[strength], F.lit(0))


def strength_name(rank: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for s, r in X.STRENGTH_RANK for x in (r, s)])[rank], F.lit("CIRCUMSTANTIAL"))


def evidence_items(met: DataFrame, features: DataFrame, content: DataFrame) -> DataFrame:
    """Evidence items of channels in long form (DM-1..4): (channel, evidence_type, source, value, strength).

    ``met`` of :func:`vigilspark.operators.linking.values_met`: an item for each time a value is listed
    and one if channels share it; ``features`` (channel, deletion_rate, backup_mentions, urgency_share);
    ``content`` of :func:`content_marks`.
    """

    def item(kind: str, source: str, value: str, strength: Column | str, when: str = "true") -> Column:
        strength = F.lit(strength) if isinstance(strength, str) else strength
        made = F.struct(F.lit(kind).alias("evidence_type"), F.lit(source).alias("source"), F.col(value).cast("string").alias("value"), strength.alias("strength"))
        return F.when(F.expr(when), made)

    def of(df: DataFrame, *made: Column) -> DataFrame:
        """One pass over each input gives all its items."""
        return df.select("channel", F.explode(F.array_compact(F.array(*made))).alias("i")).select("channel", "i.*")

    wide = F.when((F.col("entity_type") != "URL") & (F.col("n_channels") >= 3), "STRONG").otherwise("MODERATE")
    told = of(
        features,
        item("DELETION_PATTERN", "message_id_analysis", "deletion_rate", "WEAK", "deletion_rate > 0.3"),
        item("BACKUP_CHANNEL_MENTION", "text_analysis", "backup_mentions", "MODERATE", "backup_mentions > 0"),
        item("URGENCY_PRESSURE", "text_analysis", "urgency_share", "CIRCUMSTANTIAL", "urgency_share > 0.15"),
    )
    said = of(
        content,
        item("IMPERSONATION_DETECTED", "text_pattern_match", "impersonated", "MODERATE", "impersonated <> ''"),
        item("FINANCIAL_PROMISE", "text_pattern_match", "promise", "WEAK", "promise <> ''"),
        item("SCAM_CATEGORY_MATCH", "rule_based_classifier", "category", "CIRCUMSTANTIAL", "category <> 'UNKNOWN'"),
    )
    listed = F.array_repeat(item("BLOCKLIST_MATCH", "blocklist", "value", "DEFINITIVE"), F.col("n_listed").cast("int"))
    held = F.array_compact(F.array(item("SHARED_ENTITY", "entity_sharing", "value", wide, "n_channels >= 2")))
    points = met.select("channel", F.explode(F.concat(listed, held)).alias("i")).select("channel", "i.*")
    return points.unionByName(told).unionByName(said)


def content_marks(texts: DataFrame, first: int = 200) -> DataFrame:
    """(channel, impersonated, promise, category) of the first posts of each channel, read as one text (DM-4).

    ``texts``: (channel, message_id, text).  The rank keeps ``first`` posts a channel before
    they are joined, so no row grows with a channel.  Null texts count as empty.
    """
    from vigilspark.functions import text as T

    rank = F.row_number().over(W.partitionBy("channel").orderBy("message_id", "text"))
    held = texts.withColumn("nth", rank).where(F.col("nth") <= first)
    posts = F.array_sort(F.collect_list(F.struct("nth", F.coalesce(F.lower("text"), F.lit("")).alias("text"))))
    joined = held.groupBy("channel").agg(F.array_join(F.transform(posts, lambda p: p["text"]), " ").alias("text"))
    t = F.col("text")
    return joined.select("channel", T.impersonated(t).alias("impersonated"), T.financial_promise(t).alias("promise"), T.rule_category(t).alias("category"))


def content_marks_whole(texts: DataFrame, chunk: int = 500, ahead: int = 100) -> DataFrame:
    """As :func:`content_marks`, of all posts of each channel, read as one text in order of message and text.

    The text of a channel is cut into chunks of ``chunk`` posts that are not blank, each followed by the next ``ahead``
    such posts, so a row is bounded however much a channel posts.  A phrase spans fewer words than that, so each one lies whole in some chunk.
    Chunks are joined by pattern: what is found in any, the promise in the first.
    """
    from vigilspark.functions import text as T

    said = texts.select("channel", "message_id", "text", F.coalesce(F.lower("text"), F.lit("")).alias("low"))
    order = W.partitionBy("channel").orderBy("message_id", "text")
    said = said.withColumns({"nth": F.sum(F.col("low").rlike(r"\S").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)), "row": F.row_number().over(order)})
    own = F.floor(F.col("nth") / chunk)
    both = F.when((own > 0) & (F.col("nth") % chunk < ahead), F.array(own - 1, own)).otherwise(F.array(own))
    posts = F.array_sort(F.collect_list(F.struct("row", F.col("low").alias("text"))))
    chunks = said.withColumn("chunk", F.explode(both)).groupBy("channel", "chunk").agg(F.array_join(F.transform(posts, lambda p: p["text"]), " ").alias("text"))
    marks = {"context": T.any_word(F.col("text"), X.SCAM_CONTEXT), "who": T.first_match([(str(k), F.col("text").contains(w)) for k, (w, _) in enumerate(X.IMPERSONATION)], None).cast("int")}
    marks |= {f"promise{k}": F.nullif(F.regexp_extract("text", p, 0), F.lit("")) for k, p in enumerate(X.FINANCIAL_PROMISES)}
    marks |= {f"rule{k}": T.rule_bits(F.col("text"), patterns) for k, (_, patterns) in enumerate(X.RULE_PATTERNS)}
    found = chunks.select("channel", "chunk", *[c.alias(n) for n, c in marks.items()])
    promises = [f"promise{k}" for k in range(len(X.FINANCIAL_PROMISES))]
    rules = [f"rule{k}" for k in range(len(X.RULE_PATTERNS))]
    of = found.groupBy("channel").agg(
        F.bool_or("context").alias("context"), F.min("who").alias("who"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk"))).alias(c) for c in promises], *[F.bit_or(c).alias(c) for c in rules]
    )
    names = F.array(*[F.lit(who) for _, who in X.IMPERSONATION])
    who = F.when(F.col("context") & F.col("who").isNotNull(), F.get(names, F.col("who"))).otherwise(F.lit(""))
    promise = F.substring(F.coalesce(*promises, F.lit("")), 1, 80)
    return of.select("channel", who.alias("impersonated"), promise.alias("promise"), T.most_hits([F.bit_count(c) for c in rules]).alias("category"))


def freeze_requests(events: DataFrame) -> DataFrame:
    """State of freeze requests from their events (DM-28): PENDING, then SUBMITTED or REJECTED by the last answer.

    ``events``: (request_id, upi, kind CREATE or SUBMIT, accepted, reference, ts), any order.  A
    submission before its creation, or of a request never created, changes nothing and is counted.
    Aggregates only, so a request with many events is never one list.
    """
    created = events.where("kind = 'CREATE'").groupBy("request_id").agg(F.min_by("upi", F.struct("ts", "upi")).alias("upi"), F.min("ts").alias("created_at"))
    answers = events.where("kind = 'SUBMIT'").join(created.select("request_id", "created_at"), "request_id", "left")
    valid = F.col("ts") >= F.col("created_at")
    order = F.when(valid, F.struct("ts", "accepted", "reference"))
    last = answers.groupBy("request_id").agg(F.max(order).alias("last"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("refused"))
    joined = created.join(last, "request_id", "full")
    status = (
        F.when(F.col("created_at").isNull(), "NOT_FOUND").when(F.col("last").isNull(), "PENDING").when(F.col("last.accepted"), "SUBMITTED").otherwise("REJECTED")
    )
    sent = status == "SUBMITTED"
    return joined.select(
        "request_id", "upi", status.alias("status"), "created_at", F.when(sent, F.col("last.ts")).alias("submitted_at"),
        F.when(sent, F.col("last.reference")).otherwise("").alias("reference"), F.coalesce("refused", F.lit(0)).alias("refused"),
    )


def top_with_items(groups: DataFrame, order: list[Column], n: int, items: DataFrame, key: str, item_order: list[Column], item: str, k: int) -> DataFrame:
    """The first ``n`` groups, each with its first ``k`` items in ``items`` (SO-4, SO-6, SO-10, SO-11).

    The chosen groups are at most ``n`` rows, so items are cut to them before they are ranked.
    """
    top = groups.orderBy(*order).limit(n)
    ranked = items.join(F.broadcast(top.select(key)), key).withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(*item_order))).where(F.col("nth") <= k)
    listed = ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", item))), lambda x: x[item]).alias("items"))
    return top.join(listed, key, "left")


def feed_rows(posts: DataFrame, length: int = 200) -> DataFrame:
    """Posts as rows of a feed with previews of their texts (RM-29); null texts are empty."""
    return posts.select(
        "id", F.substring(F.coalesce("text", F.lit("")), 1, length).alias("raw_text"), F.lit("").alias("image_text"), F.concat(F.lit("post-"), F.col("id").cast("string")).alias("record_id")
    )


def populated_fields(channels: DataFrame, posts: DataFrame, texts: DataFrame, channel_entities: DataFrame, metadata: DataFrame) -> DataFrame:
    """(channel, populated, n_posts): how many of the seven expected fields of a channel hold something (DM-6).

    The fields are posts, entities, metadata, posting schedule (posts with a time),
    language distribution (texts), media ratio (posts with media) and growth
    snapshots (two posts with views).  Each part is one aggregate by channel.
    """
    by_posts = posts.groupBy("channel").agg(
        F.count("*").alias("n_posts"), F.count("ts").alias("timed"), F.count_if(F.col("media") != "none").alias("shown"), F.count_if(F.col("views") > 0).alias("snapshots")
    )
    flag = lambda df, name: df.groupBy("channel").agg(F.count("*").alias(name))
    joined = channels.join(by_posts, "channel", "left").join(flag(texts.where("text <> ''"), "told"), "channel", "left")
    joined = joined.join(flag(channel_entities, "found"), "channel", "left").join(flag(metadata, "known"), "channel", "left")
    has = lambda c, n=1: F.coalesce((F.col(c) >= n).cast("int"), F.lit(0))
    populated = has("n_posts") + has("found") + has("known") + has("timed") + has("told") + has("shown") + has("snapshots", 2)
    return joined.select("channel", populated.alias("populated"), F.coalesce("n_posts", F.lit(0)).alias("n_posts"))


def confidence(channels: DataFrame, items: DataFrame) -> DataFrame:
    """Confidence of a channel's assessment (DM-6, AG-25, AG-26).

    ``channels``: (channel, populated, n_posts); ``items`` of :func:`evidence_items`.
    Agreement is the share of the most frequent strength.  Items are counted by source
    first, so that sets are made of a few rows a channel and not of its items.
    """
    by_source = items.groupBy("channel", "strength", "source").agg(F.count("*").alias("n"))
    by_strength = by_source.groupBy("channel", "strength").agg(F.sum("n").alias("n"), F.collect_set("source").alias("sources"))
    grouped = by_strength.groupBy("channel").agg(
        F.sum("n").alias("n_items"), F.max("n").alias("top"), F.max(strength_rank(F.col("strength"))).alias("rank"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
    )
    joined = channels.join(grouped, "channel", "left")
    completeness = F.col("populated") / len(X.EXPECTED_FIELDS)
    extraction = F.when(F.col("n_items") > 0, F.lit(1.0)).otherwise(F.lit(0.1))
    agreement = F.coalesce(F.col("top") / F.col("n_items"), F.lit(0.0))
    floor = lambda c: F.greatest(c, F.lit(0.01))
    mean = F.round(F.pow(floor(completeness) * floor(extraction) * floor(agreement), F.lit(1.0 / 3)), 4)
    overall = F.least(F.when(F.col("n_posts") < 20, mean * 0.5).otherwise(mean), F.lit(0.99))
    level = (
        F.when((F.col("overall") >= 0.6) & (F.col("n_posts") >= 100) & (F.col("sources") >= 2), "HIGH")
        .when((F.col("overall") >= 0.35) & (F.col("n_posts") >= 20), "MODERATE").when(F.col("overall") >= 0.15, "LOW").otherwise("INSUFFICIENT")
    )
    scored = joined.select(
        "channel", "n_posts", F.round(completeness, 4).alias("completeness"), F.round(agreement, 4).alias("agreement"), F.coalesce("sources", F.lit(0)).alias("sources"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("rank", F.lit(0)).alias("rank"), F.round(overall, 6).alias("overall"),
    )
    return scored.withColumn("confidence_class", level)


def recommendation(assessed: DataFrame) -> DataFrame:
    """Action, urgency and suppression from the strongest evidence and the confidence (DM-7, DM-8); first rule wins."""
    rank, level = F.col("rank"), F.col("confidence_class")
    sure = level.isin("HIGH", "MODERATE")
    action = (
        F.when((rank == 5) & sure, "TAKEDOWN_REQUEST").when((rank >= 4) & sure, "PRIORITY_INVESTIGATION")
        .when(rank >= 3, "ANALYST_REVIEW").when(rank >= 2, "AUTOMATED_MONITORING").otherwise("NO_ACTION")
    )
    urgency = (
        F.when((rank == 5) & (level == "HIGH"), "IMMEDIATE").when((rank >= 4) & sure, "24_HOURS").when(rank >= 3, "ROUTINE").otherwise("DEFERRED")
    )
    acting = ~F.col("action").isin("NO_ACTION", "AUTOMATED_MONITORING")
    reason = (
        F.when((F.col("action") == "TAKEDOWN_REQUEST") & level.isin("LOW", "INSUFFICIENT"), "CONFIDENCE")
        .when((F.col("n_items") > 0) & (rank == 1) & acting, "CIRCUMSTANTIAL")
        .when((F.col("sources") < 2) & F.col("action").isin("TAKEDOWN_REQUEST", "PRIORITY_INVESTIGATION"), "SOURCES")
        .when((F.col("completeness") < 0.4) & acting, "COMPLETENESS").when((F.col("n_posts") < 5) & acting, "POSTS").otherwise("")
    )
    out = assessed.withColumns({"action": action, "urgency": urgency}).withColumn("suppression", reason)
    return out.withColumn("final_action", F.when(F.col("suppression") != "", "SUPPRESSED").otherwise(F.col("action")))


def decision_score(c: DataFrame) -> DataFrame:
    """Weighted decision score 0-100 (DM-11).

    ``c``: (channel, xref_hits, domain_hits, upis, phones, bad_tld, linked, forward_ratio, connections, campaigns,
    overlap, similarity, subscribers, urgency_pct, backup, deletion_rate, confidence, has_qr, image_pct, hinglish).
    Domain matches add 25 each until the score has reached 65, checked after each, so the count that matters is
    closed form.
    """
    n = F.col
    zero = F.lit(0.0)
    xref = F.least(F.lit(40.0), n("xref_hits") * 20.0)
    used = F.least(n("domain_hits").cast("double"), F.greatest(F.lit(1.0), F.ceil((65 - xref) / 25).cast("double")))
    infra = F.least(
        F.lit(100.0),
        xref + used * 25 + F.when(n("upis") > 0, F.least(F.lit(15.0), n("upis") * 5.0)).otherwise(zero)
        + F.when(n("phones") > 2, F.least(F.lit(10.0), n("phones") * 3.0)).otherwise(zero) + F.when(n("bad_tld"), 10.0).otherwise(zero),
    )
    network = F.least(
        F.lit(100.0),
        F.when(n("linked") > 5, F.least(F.lit(30.0), n("linked") * 3.0)).otherwise(zero) + F.when(n("forward_ratio") > 0.3, 20.0).otherwise(zero)
        + F.when(n("connections") > 10, F.least(F.lit(25.0), n("connections") * 2.0)).otherwise(zero)
        + F.when(n("campaigns") > 0, F.least(F.lit(15.0), n("campaigns") * 5.0)).otherwise(zero)
        + F.when(n("overlap") > 0, F.least(F.lit(20.0), n("overlap") * 10.0)).otherwise(zero),
    )
    behaviour = F.least(
        F.lit(100.0),
        F.when(n("similarity") > 0.8, 40.0).when(n("similarity") > 0.6, 20.0).otherwise(zero) + F.when(n("subscribers") > 10_000, 10.0).otherwise(zero)
        + F.when(n("urgency_pct") > 30, 25.0).when(n("urgency_pct") > 10, 10.0).otherwise(zero) + F.when(n("backup") > 0, 15.0).otherwise(zero)
        + F.when(n("deletion_rate") > 0.3, 10.0).otherwise(zero),
    )
    content = F.least(
        F.lit(100.0),
        F.when(n("confidence") > 0.8, 50.0).when(n("confidence") > 0.5, 25.0).otherwise(zero) + F.when(n("has_qr") & (n("upis") > 0), 20.0).otherwise(zero)
        + F.when((n("image_pct") > 50) & (n("upis") > 0), 15.0).otherwise(zero) + F.when(n("hinglish") > 0.3, 10.0).otherwise(zero),
    )
    total = F.round(0.30 * infra + 0.25 * network + 0.25 * behaviour + 0.20 * content, 2)
    return c.select(
        "channel", infra.alias("infrastructure"), network.alias("network"), behaviour.alias("behavioral"), content.alias("content"), total.alias("score"), S.decision(total).alias("decision")
    )


def roles(messages: DataFrame) -> DataFrame:
    """Role of each user from the words of all their messages (DM-15): (user, role, confidence, activity)."""
    t = F.lower("text")
    flags = [(name, weight, [F.max(F.coalesce(t.contains(w.lower()).cast("int"), F.lit(0))) for w in words]) for name, weight, words in X.ROLES]
    aggregates = [sum(hits[1:], hits[0]).alias(name) for name, _, hits in flags]
    entity = F.count_if(F.col("text").rlike(X.ROLE_ENTITY))
    g = messages.groupBy("user").agg(*aggregates, F.count("*").alias("n"), entity.alias("with_entity"))
    best = F.array_max(F.array(*[F.struct((F.col(name) * weight).alias("s"), F.lit(-k).alias("o"), F.lit(name).alias("role")) for k, (name, weight, _) in enumerate(X.ROLES)]))
    some = best["s"] > 0
    return g.select(
        "user", F.when(some, best["role"]).otherwise("UNKNOWN").alias("role"),
        F.when(some, F.round(F.least(F.lit(0.95), 0.4 + best["s"] * 0.1), 4)).otherwise(0.3).alias("confidence"),
        F.round(F.least(F.lit(100.0), F.col("n") * 2.0) + F.least(F.lit(20.0), F.col("with_entity") * 3.0), 1).alias("activity"),
    )


def viral_spread(appearances: DataFrame) -> DataFrame:
    """First place, velocity, reach and score of each image (AG-22)."""
    hours = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3_600_000_000
    g = appearances.groupBy("image").agg(
        F.count("*").alias("n"), hours.alias("hours"), F.count_distinct("platform").alias("platforms"), F.sum("reach").alias("reach"),
        F.min_by("platform", F.struct("ts", "id")).alias("first_platform"), F.min_by("channel", F.struct("ts", "id")).alias("first_channel"),
    )
    score = F.least(F.lit(100.0), F.col("n") * 3 + F.col("platforms") * 15 + F.least(F.lit(30.0), F.col("reach") / 1000))
    return g.select(
        "image", "n", "platforms", "reach", "first_platform", "first_channel",
        F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("n") / F.greatest(F.lit(1.0), "hours"), 4)).alias("velocity"), F.round(score, 2).alias("score"),
    )


def template_versions(templates: DataFrame) -> DataFrame:
    """Version chain of each campaign's templates with similarity to the previous one (WN-2)."""
    from vigilspark.functions.text import phash_similarity

    w = W.partitionBy("campaign").orderBy("first_seen", "phash")
    before = F.lag("phash").over(w)
    similarity = F.when(before.isNull(), F.lit(1.0)).otherwise(F.round(phash_similarity(before, F.col("phash")), 4))
    change = S.ladder(F.col("similarity"), [(0.95, "minor"), (0.85, "moderate"), (0.70, "major")], "redesign")
    return templates.select("campaign", "phash", F.concat(F.lit("v"), F.row_number().over(w).cast("string")).alias("version"), similarity.alias("similarity")).withColumn("change", change)


def growth_forecast(joined: DataFrame, as_of: DataFrame) -> DataFrame:
    """Channels, new ones in the last day, growth and the 30-day projection of each campaign (AG-52, GR-8).

    ``joined``: (campaign, channel, created, victims); ``as_of``: one row with the column ``now``.
    """
    recent = F.count_if(F.col("created") >= F.col("now") - F.expr("INTERVAL 1 DAY"))
    g = joined.withColumn("now", as_of.select("now").scalar()).groupBy("campaign").agg(F.count("*").alias("channels"), recent.alias("new_24h"), F.sum("victims").alias("victims"))
    rate = F.col("new_24h") / F.greatest(F.col("channels") - F.col("new_24h"), F.lit(1))
    return g.select(
        "campaign", "channels", "new_24h", F.round(rate * 100, 2).alias("growth_pct"), F.greatest(F.lit(1), F.floor(F.col("victims") / 7)).cast("long").alias("victims_per_day"),
        F.round(F.col("channels") * F.pow(1 + F.least(rate, F.lit(1.0)), F.lit(30.0)), 0).alias("in_30_days"), (F.col("channels") * 500).alias("reach"),
        F.when(rate > 0.2, 3).when(rate > 0.1, 2).when(rate > 0.05, 1).otherwise(0).alias("platforms_added"),
    )


def ego_network(edges: DataFrame, centre: str) -> DataFrame:
    """Neighbours of a node at distance one, undirected, with the number of links (GR-3, JN-15)."""
    out = edges.where(F.col("src") == centre).select(F.col("dst").alias("node"), "type")
    back = edges.where(F.col("dst") == centre).select(F.col("src").alias("node"), "type")
    return out.unionByName(back).groupBy("node", "type").agg(F.count("*").alias("links"))


def merge_nodes(seen: DataFrame) -> DataFrame:
    """Node upsert: one row for each (label, key) with count, first and last sight (SC-28)."""
    return seen.groupBy("label", "key").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merge_edges(seen: DataFrame) -> DataFrame:
    """Edge upsert: one row for each (src, dst, type) (SC-29, GR-7)."""
    return seen.groupBy("src", "dst", "type").agg(F.count("*").alias("count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"))


def alerts(campaigns: DataFrame) -> DataFrame:
    """Threshold alerts of campaigns in long form (ST-7, G11): all types that have a threshold.

    ``campaigns``: (campaign, channels, growth_pct, reach, platforms, repeats, activity_ratio).
    """
    t = X.ALERT_THRESHOLDS
    new = F.floor(F.col("channels") * F.col("growth_pct") / 100)
    made = F.array_compact(
        F.array(
            F.when(new >= t["new_channels_24h"], F.struct(F.lit("RAPID_GROWTH").alias("alert_type"), F.lit("CRITICAL").alias("severity"))),
            F.when(F.col("reach") >= t["estimated_reach"], F.struct(F.lit("HIGH_VICTIM_RISK").alias("alert_type"), F.lit("CRITICAL").alias("severity"))),
            F.when(F.col("platforms") >= t["platforms"], F.struct(F.lit("CROSS_PLATFORM").alias("alert_type"), F.lit("EMERGENCY").alias("severity"))),
            F.when(F.col("repeats") >= t["campaign_count"], F.struct(F.lit("ENTITY_REPEAT").alias("alert_type"), F.lit("HIGH").alias("severity"))),
            F.when(F.col("activity_ratio") >= t["activity_multiplier"], F.struct(F.lit("EMERGING_HOTSPOT").alias("alert_type"), F.lit("WARNING").alias("severity"))),
            F.when(F.col("channels") <= 2, F.struct(F.lit("NEW_CAMPAIGN").alias("alert_type"), F.lit("WATCH").alias("severity"))),
        )
    )
    return campaigns.select("campaign", F.explode(made).alias("a")).select("campaign", "a.alert_type", "a.severity")
