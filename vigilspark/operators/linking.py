"""Joins that link posts, channels and identities (JN-1..8, JN-12..16, SE-4, WN-4, SO-6)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import scores as S
from vigilspark.operators.components import connected_components
from vigilspark.operators.patterns import contained
from vigilspark.storage import materialize


def shared_entities(channel_entities: DataFrame) -> DataFrame:
    """Values that at least two channels show, with the sorted channels (JN-2)."""
    grouped = channel_entities.groupBy("entity_type", "value").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    return grouped.where(F.size("channels") >= 2).select("entity_type", "value", "channels", F.size("channels").alias("n_channels"))


def shared_counts(channel_entities: DataFrame) -> DataFrame:
    """(entity_type, value, n_channels) of values that at least two channels show: counts alone, pre-aggregated."""
    return channel_entities.groupBy("entity_type", "value").agg(F.count("*").alias("n_channels")).where("n_channels >= 2")


def values_met(channel_entities: DataFrame, blocked: DataFrame) -> DataFrame:
    """(channel, entity_type, value, n_channels, n_listed) of contact points that at least two channels show or a list names.

    ``channel_entities``: (channel, entity_type, value), distinct; ``blocked``: (entity_type, value),
    counted as often as it is listed.  Both are counted by value together and meet the contact points in one
    join.  Its first key is a number, which a sort compares far faster than texts with a common beginning.
    """
    keys = [F.xxhash64("entity_type", "value").alias("_h"), "entity_type", "value"]
    shown = channel_entities.select(*keys, F.lit(1).alias("shown"), F.lit(0).alias("listed"))
    named = blocked.select(*keys, F.lit(0).alias("shown"), F.lit(1).alias("listed"))
    values = shown.unionByName(named).groupBy("_h", "entity_type", "value").agg(F.sum("shown").alias("n_channels"), F.sum("listed").alias("n_listed"))
    values = values.where("n_channels >= 2 or n_listed > 0")
    return channel_entities.select("channel", *keys).join(values, ["_h", "entity_type", "value"]).select("channel", "entity_type", "value", "n_channels", "n_listed")


#: Entity types and the columns of their Jaccard overlap.
JACCARD_KINDS = {"UPI": "j_upi", "PHONE": "j_phone", "URL": "j_domain", "IMAGE": "j_image"}


#: Channels up to which a row for each is broadcast; more are met by exchanges.
FEW = 500_000


def _placed(channels: DataFrame, held: int):
    """(the block of a channel as a function of its column, the number of blocks, whether blocks follow the order of channels, the number of channels).

    A block has about ``held`` channels.  Near numbers share a block, since channels with near numbers often have values in
    common: ranges of equal width, at most 4,096.  A range with many more channels is dealt to several blocks by
    hash, as channels without numbers are.
    """
    deal = lambda c, k: F.pmod(F.xxhash64(c), k)
    numbers = channels.schema["channel"].dataType.typeName() in ("byte", "short", "integer", "long")
    n, low, high = channels.agg(F.count("*"), *[f("channel") if numbers else F.lit(0) for f in (F.min, F.max)]).first()
    held = max(1, min(held, n // (2 * channels.sparkSession.sparkContext.defaultParallelism)))
    ranges = min(4096, n // held + 1)
    if not numbers or not n:
        return (lambda c: deal(c, F.lit(n // held + 1))), n // held + 1, False, n
    width = (float(high) - float(low) + 1) / ranges
    at = lambda c: F.least(F.floor(((F.col(c) if isinstance(c, str) else c).cast("double") - F.lit(float(low))) / width), F.lit(ranges - 1)).cast("int")
    counts = dict(map(tuple, channels.groupBy(at("channel").alias("at")).count().collect()))
    split = [counts.get(k, 0) // (4 * held) + 1 for k in range(ranges)]
    if max(split) == 1:
        return at, ranges, True, n
    return (lambda c: deal(c, F.get(F.lit(split), at(c))) * ranges + at(c)), sum(split), False, n


def jaccard_by_type(channel_entities: DataFrame, held: int = 512) -> DataFrame:
    """(a, b, Jaccard of the value sets of sharing channels a < b, one column for each type) (SE-4).

    Rows may repeat.  The channels of a value become one list, written.  A list goes to each block of channels (see
    :func:`_placed`) that it has some of; their pairs with later channels are made and counted
    there, so lists are shuffled and pairs are not.  The pairs then meet one row of set sizes for each channel.
    Types without a column add no overlap.
    """
    kinds = JACCARD_KINDS
    counts = lambda prefix: [F.count_if(F.col("kind") == k).alias(prefix + c) for k, c in enumerate(kinds.values())]
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("entity_type")), F.lit(0)).cast("int") - 1
    lists = channel_entities.groupBy("entity_type", "value").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    lists = materialize(lists.select(kind.alias("kind"), F.expr("entity_type is not null and value is not null").alias("known"), "channels"), "lists")
    sizes = lists.select("kind", F.explode("channels").alias("channel")).groupBy("channel").agg(*counts("n_"))
    place, blocks, ordered, n = _placed(materialize(lists.select(F.explode("channels").alias("channel")).distinct(), "channels"), held)
    several = lists.where("known and size(channels) > 1").select("kind", "channels")
    if ordered:  # the channels of a block stand together: a list is cut where a block begins
        each = several.select("kind", "channels", F.posexplode("channels").alias("i", "c")).withColumn("block", place("c"))
        begins = (F.col("i") == 0) | (F.col("block") != place(F.get("channels", F.col("i") - 1)))
        sent = each.where(begins).select("kind", "block", F.slice("channels", F.col("i") + 1, F.size("channels")).alias("channels")).where("size(channels) > 1")
    else:
        sent = several.select("kind", "channels", F.explode(F.array_distinct(F.transform("channels", place))).alias("block"))
    parts = min(4096, max(2 * blocks, channel_entities.sparkSession.sparkContext.defaultParallelism))
    first = sent.repartition(parts, "block").select("kind", "block", "channels", F.posexplode("channels").alias("i", "a")).where(place("a") == F.col("block"))
    met = first.select("kind", "block", "a", F.explode(F.slice("channels", F.col("i") + 2, F.size("channels"))).alias("b"))
    common = met.groupBy("block", "a", "b").agg(*counts("c_"))
    how = "broadcast" if n <= FEW else "merge"
    one = sizes.select(F.col("channel").alias("a"), *[F.col(f"n_{c}").alias(f"a_{c}") for c in kinds.values()]).hint(how)
    two = sizes.select(F.col("channel").alias("b"), *[F.col(f"n_{c}").alias(f"b_{c}") for c in kinds.values()]).hint(how)
    j = lambda c: F.when(F.col(f"c_{c}") > 0, F.col(f"c_{c}") / (F.col(f"a_{c}") + F.col(f"b_{c}") - F.col(f"c_{c}"))).otherwise(F.lit(0.0))
    return common.join(one, "a").join(two, "b").select("a", "b", *[j(c).alias(c) for c in kinds.values()])


#: Cells of pairs near in time have some hundred times the square of this number of pairs.
BLOCK = 1024


def close_in_time(
    channels: DataFrame, hours: float, but: DataFrame | None = None, possible: Column | None = None, block: int = BLOCK, down: Column | None = None, up: Column | None = None
) -> DataFrame:
    """Pairs a < b where b was created within ``hours`` of a's takedown, before or after, with all columns as ``x_a`` and ``x_b``.

    Left out are the pairs (a, b) of ``but`` and those that are not ``possible`` (a condition on the columns);
    ``down`` and ``up`` say which channels can be a and b.
    ``channels`` has one row a channel.  An equi join on time buckets of that width (the creation meets
    the takedowns of its own bucket and of the two beside it) and on cells, blocks of takedowns by blocks of creations: a
    takedown goes to each block of creations, with the partners of ``but`` there, and a creation to each block of takedowns,
    so pairs are made and judged in place and none is shuffled.  There are so many cells that a cell's pairs stay below a
    bound; what is copied grows with the number of channels times the root of that of cells.
    """
    width = max(1, int(hours * 3_600_000_000) + 1)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lost = channels.where("taken_down is not null").where(F.lit(True) if down is None else down)
    new = channels.where("created is not null").where(F.lit(True) if up is None else up)
    takedowns, creations = lost.count(), new.count()
    cells = max(4 * channels.sparkSession.sparkContext.defaultParallelism, takedowns * creations // (96 * block * block) + 1)
    across = min(cells, max(1, round(math.sqrt(cells * takedowns / max(1, 3 * creations)))))
    along = -(-cells // across)
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>"))
    named = lambda df, x: df.select(*[F.col(c).alias(f"{c}_{x}") for c in channels.columns])
    left = named(lost, "a").withColumns({"bucket": F.floor(micros("taken_down_a") / width), "row": place("channel_a", across), "block": every(along)})
    if but is not None:
        known = but.groupBy(F.col("a").alias("channel_a"), place("b", along).alias("block")).agg(F.collect_list("b").alias("known"))
        left = left.join(known.hint("merge"), ["channel_a", "block"], "left")
    own = F.floor(micros("created_b") / width)
    right = named(new, "b").withColumn("block", place("channel_b", along)).withColumn("bucket", F.explode(F.array(own - 1, own, own + 1))).withColumn("row", every(across))
    # a stated number of partitions, since adaptive execution would merge these few bytes into a few long tasks
    parts = min(4096, 2 * across * along)
    left, right = (df.repartition(parts, "bucket", "block", "row") for df in (left, right))
    near = (F.col("channel_a") < F.col("channel_b")) & (F.abs(micros("created_b") - micros("taken_down_a")) <= width)
    if possible is not None:
        near = near & possible
    if but is not None:
        near = near & ~F.coalesce(F.array_contains("known", F.col("channel_b")), F.lit(False))
    return left.join(right.hint("shuffle_hash"), ["bucket", "block", "row"]).where(near).drop("bucket", "block", "row", "known")


def temporal_window(min_probability: float) -> float:
    """Hours between takedown and creation beyond which a pair without a common entity stays below the threshold."""
    from vigilspark.functions.fixed import ATTRIBUTION as A
    from vigilspark.functions.fixed import DECAY_HOURS

    p = min_probability - 0.00006  # probabilities are compared after rounding to four places
    least = (math.log(p / (1 - p)) - A["prior"] - A["behavioral"] - A["content"]) / A["temporal"]
    if least <= 0:
        raise ValueError("candidate generation is lossless for thresholds of 0.08 or more")
    return -DECAY_HOURS * math.log(min(least, 1.0))


def _profiled(channels: DataFrame) -> DataFrame:
    """``channels``, written, with the lengths of their vectors; vectors of one common size become a column for each number."""
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    times = {c: F.col(c).cast("timestamp") for c in ("taken_down", "created")}  # once a channel, not once a pair
    rows = materialize(channels.withColumns({"square": square, "norm": F.sqrt(square)} | times), "profiles")
    n, held, low, high = rows.agg(F.count("*"), F.count("vector"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if n and n == held and low == high and low <= 32:
        rows = rows.select(*[c for c in rows.columns if c != "vector"], *[F.get("vector", F.lit(k)).alias(f"v{k}") for k in range(low)])
    return rows


def _overlaps(channel_entities: DataFrame) -> DataFrame:
    """(a, b, infra) of the channels that share an entity, written."""
    from vigilspark.functions.fixed import INFRA_WEIGHTS as I

    infra = I["upi"] * F.col("j_upi") + I["phone"] * F.col("j_phone") + I["domain"] * F.col("j_domain") + I["image"] * F.col("j_image")
    return materialize(jaccard_by_type(channel_entities).select("a", "b", infra.alias("infra")), "overlaps")


def attribution(channels: DataFrame, channel_entities: DataFrame, min_probability: float = 0.2) -> DataFrame:
    """Log-odds that two channels have one operator (DM-10, JN-6), pairs at or above ``min_probability``.

    ``channels``: (channel, vector, category, impersonated, promises, taken_down, created, n_evidence).
    Candidates are the pairs that share an entity and the pairs whose takedown and
    creation are close: without either the probability cannot exceed 0.076, and
    without a common entity it reaches a threshold of 0.08 or more only within
    :func:`temporal_window` hours, so no pair is lost.
    """
    hours = temporal_window(min_probability)
    channels, overlaps = _profiled(channels), _overlaps(channel_entities)
    scored, possible = _scoring(channels, min_probability)
    near = close_in_time(channels, hours, overlaps.select("a", "b"), possible)
    return scored(_sharing(channels, overlaps), F.col("infra")).unionByName(scored(near, F.lit(0.0)))


def spanning(edges: DataFrame, most: int = 200_000) -> DataFrame:
    """Of edges (a, b), as many as keep the components that a task sees, about ``most`` nodes at a time: few where edges are dense."""

    def run(batches):
        above = {}

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            kept_a, kept_b = [], []
            for a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                one, two = top(a), top(b)
                if one != two:
                    above[two] = one
                    kept_a.append(a)
                    kept_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((kept_a, kept_b), batch.schema.types, strict=True)], ["a", "b"])
            if len(above) > most:
                above = {}

    edges = edges.select("a", "b")
    return edges.mapInArrow(run, edges.schema)


def operator_components(channels: DataFrame, channel_entities: DataFrame, min_probability: float = 0.2, pivots: int = 16) -> DataFrame:
    """(node, component) of the channels that pairs of :func:`attribution` link, without a list of these pairs.

    A few pivots (the first takedowns, the last creations and some by hash) are compared with all channels first.  After that
    only pairs of two components are judged: near pairs within the largest one are not even made.
    What they add is thinned in its task to edges that span the same components.  A near pair is judged
    without its common entities, which only raise the probability; with them it is among the sharing pairs.
    """
    hours = temporal_window(min_probability)
    channels, overlaps = _profiled(channels), _overlaps(channel_entities)

    def near(rows: DataFrame, down: Column | None = None, up: Column | None = None, when: Column | None = None) -> DataFrame:
        scored, possible = _scoring(channels, min_probability)
        return scored(close_in_time(rows, hours, None, possible if when is None else when & possible, down=down, up=up), F.lit(0.0)).select("a", "b")

    def some(rows: DataFrame, first: Column) -> Column:
        ids = [r[0] for order in (first, F.xxhash64("channel")) for r in rows.orderBy(order).limit(pivots).select("channel").collect()]
        return F.col("channel").isin(ids)

    begin = near(channels, down=some(channels.where("taken_down is not null"), F.col("channel"))).unionByName(near(channels, up=some(channels.where("created is not null"), F.desc("channel"))))
    found = materialize(connected_components(spanning(begin), "a", "b"), "found")
    largest = found.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).collect()
    placed = channels.join(found.select(F.col("node").alias("channel"), "component").hint("merge"), "channel", "left").withColumn("component", F.coalesce("component", "channel"))
    placed = materialize(placed, "placed")
    inside = F.col("component") == F.lit(largest[0]["component"]) if largest else F.lit(False)
    other = F.col("component_a") != F.col("component_b")
    scored, _ = _scoring(channels, min_probability)
    sharing = scored(_sharing(placed, overlaps).where(other), F.col("infra")).select("a", "b")
    more = sharing.unionByName(near(placed, down=inside, up=~inside, when=other)).unionByName(near(placed, down=~inside, when=other))
    edges = spanning(more).unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return connected_components(edges, "a", "b")


def _sharing(channels: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Pairs that share an entity with all columns as ``x_a`` and ``x_b``: pairs stay where they are, up to ``FEW`` channels."""
    how = "broadcast" if channels.count() <= FEW else "merge"
    a, b = (channels.select(*[F.col(c).alias(f"{c}_{x}") for c in channels.columns]).hint(how) for x in "ab")
    return overlaps.join(a, F.col("a") == F.col("channel_a")).join(b, F.col("b") == F.col("channel_b"))


def _scoring(channels: DataFrame, min_probability: float):
    """(a function from pairs and their common infrastructure to scored pairs, the condition on pairs without overlap whatever the behaviour)."""
    from vigilspark.functions.fixed import ATTRIBUTION as A

    length = F.col("norm_a") * F.col("norm_b")
    sizes = sum(c[0] == "v" and c[1:].isdigit() for c in channels.columns)
    if "vector" in channels.columns:
        dot, alike = F.aggregate(F.zip_with("vector_a", "vector_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), F.size("vector_a") == F.size("vector_b")
    else:
        dot, alike = reduce(lambda s, k: s + F.col(f"v{k}_a") * F.col(f"v{k}_b"), range(sizes), F.lit(0.0)), F.lit(True)
    cosine = F.when(alike & (length > 1e-20), dot / length).otherwise(F.lit(0.0))
    behaviour = F.when((F.col("square_a") > 1e-20) & (F.col("square_b") > 1e-20), (cosine + 1) / 2).otherwise(F.lit(0.0))
    hours = (F.unix_micros(F.col("created_b").cast("timestamp")) - F.unix_micros(F.col("taken_down_a").cast("timestamp"))) / 3_600_000_000
    temporal = S.decay(hours)
    content = (
        F.when((F.col("category_a") != "UNKNOWN") & (F.col("category_a") == F.col("category_b")), 0.4).otherwise(0.0)
        + F.when((F.col("impersonated_a") != "") & (F.col("impersonated_a") == F.col("impersonated_b")), 0.4).otherwise(0.0)
        + F.when(F.col("promises_a") & F.col("promises_b"), 0.2).otherwise(0.0)
    )

    def scored(pairs: DataFrame, infra: Column) -> DataFrame:
        # made once a pair: as columns of a projection they would be copied into each place that uses them, more code than Java compiles
        made = F.struct(
            F.col("channel_a").alias("a"), F.col("channel_b").alias("b"), infra.alias("infra"), behaviour.alias("behaviour"), temporal.alias("temporal"), content.alias("content"),
            (F.col("n_evidence_a") + F.col("n_evidence_b")).alias("n"),
        )
        summed = (
            A["prior"] + A["infrastructure"] * F.col("infra") + A["behavioral"] * F.col("behaviour") + A["temporal"] * F.col("temporal")
            + A["content"] * F.col("content") + A["interaction"] * F.col("infra") * F.col("temporal")
        )
        parts = pairs.select(F.inline(F.array(made))).select("*", F.explode(F.array(summed)).alias("odds"))
        odds = F.col("odds")
        low, high = S.confidence_interval(odds, F.col("n").cast("double"))
        return parts.where(S.four_places(S.sigmoid(odds)) >= min_probability).select(
            "a", "b", F.round("infra", 4).alias("infra"), S.four_places(F.col("behaviour")).alias("behaviour"), S.four_places(F.col("temporal")).alias("temporal"),
            S.four_places(F.col("content")).alias("content"), S.four_places(S.sigmoid(odds)).alias("probability"), low.alias("ci_low"), high.alias("ci_high"),
            S.attribution_strength(S.sigmoid(odds)).alias("strength"),
        )

    # without overlap, whatever the behaviour
    least = math.log((min_probability - 0.00006) / (1 - min_probability + 0.00006)) - A["prior"] - A["behavioral"]
    return scored, A["temporal"] * temporal + A["content"] * content >= least - 1e-9


def blocklist_exact(channel_entities: DataFrame, blocked: DataFrame) -> DataFrame:
    """Contact points on a blocklist (JN-3); the optimiser broadcasts the list if it is small."""
    return channel_entities.join(blocked, ["entity_type", "value"])


def blocklist_substring(urls: DataFrame, domains: DataFrame, first_only: bool) -> DataFrame:
    """Blocked domains contained in an address (JN-4, JN-5): all, or the first in alphabetical order; for lists of any size."""
    hits = contained(urls.select("id", F.col("url").alias("text")), domains.select(F.col("domain").alias("pattern"))).withColumnRenamed("pattern", "domain")
    return hits.groupBy("id").agg(F.min("domain").alias("domain")) if first_only else hits


def blocklist_hosts(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """Blocked domains that are the host of an address or a parent of it: an equi join for lists of any size."""
    from vigilspark.functions.text import url_domain

    labels = F.split(url_domain(F.col("url")), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return urls.select("id", F.explode(parents).alias("domain")).join(domains, "domain").select("id", "domain")


def entities_of_posts(posts: DataFrame, least_url: int = 11) -> DataFrame:
    """(post, entity), distinct, of (post, text): what links posts to campaigns (JN-1, AG-23).

    Phones, payment addresses, links and mentions of channels, and addresses of at least ``least_url`` characters.
    """
    from vigilspark.functions import text as T

    t = F.col("text")
    long = F.filter(T.urls(t), lambda u: F.length(u) >= least_url)
    return posts.select("post", F.explode(F.concat(T.phones(t), T.upis(t), T.telegram_links(t), long)).alias("entity")).distinct()


def cooccurring_posts(post_entities: DataFrame) -> DataFrame:
    """Pairs of posts a < b with a common entity (JN-1). For components use :func:`post_links` instead."""
    x, y = post_entities.alias("x"), post_entities.alias("y")
    pairs = x.join(y, (F.col("x.entity") == F.col("y.entity")) & (F.col("x.post") < F.col("y.post")))
    return pairs.select(F.col("x.post").alias("a"), F.col("y.post").alias("b")).distinct()


def post_links(post_entities: DataFrame) -> DataFrame:
    """(src, dst): every post linked with the first post of each of its entities - linear, same components as all pairs."""
    first = post_entities.groupBy("entity").agg(F.min("post").alias("dst"))
    return post_entities.join(first, "entity").select(F.col("post").alias("src"), "dst").distinct()


def identity_exact(entities: DataFrame) -> DataFrame:
    """Phones and payment addresses on at least two platforms (JN-7, DM-14)."""
    seen = entities.where(F.col("entity_type").isin("PHONE", "UPI")).groupBy("entity_type", "value").agg(
        F.array_sort(F.collect_set("platform")).alias("platforms"), F.count("*").alias("occurrences"), F.min("channel").alias("first_channel")
    )
    p = F.least(F.lit(0.98), 0.7 + F.size("platforms") * 0.1)
    return seen.where(F.size("platforms") >= 2).select(
        "entity_type", "value", F.array_join("platforms", ",").alias("platforms"), "occurrences", F.round(p, 4).alias("probability"),
        F.concat(F.lit("Operator via "), F.col("first_channel").cast("string")).alias("operator"),
    )


#: Letters from the most frequent on; it only orders tokens, so that prefixes hold rare ones.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
#: Names beyond this length are compared by single prefix letters, shorter ones by up to three.
_LONG = 40


def _letters(clean: Column) -> Column:
    """The letters of a name as distinct 64-bit tokens (a letter and its running number), the rarest first."""
    chars = F.split(clean, "")
    numbered = F.transform(
        chars,
        lambda x, i: F.struct(
            (-F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x))).alias("nth"),
            (-F.coalesce(F.nullif(F.instr(F.lit(_FREQUENT), x), F.lit(0)), F.lit(99))).alias("rare"), x.alias("letter"),
        ),
    )
    return F.transform(F.array_sort(numbered), lambda t: F.xxhash64(t["letter"], t["nth"]))


def letter_candidates(names: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of distinct strings that can have a Ratcliff-Obershelp similarity of ``threshold``, and few others.

    ``names``: (clean), distinct.  The similarity is 2m / (|a| + |b|) with m letters
    matched, so similar names share at least t = ceil(threshold * (|a| + |b|) / 2)
    letters, counted with repeats.  With tokens in one order everywhere, names that
    share t of them share k <= t among their first n - t + k: each choice of k = 3
    such tokens (1 or 2 where t is as small) is an equi key.  Names over 40
    letters, where choices would be many, meet by single tokens of the prefix.
    Pairs are then counted, so no pair at or above the threshold is lost.
    """
    n = F.size("tokens")
    need = lambda total: F.ceil(threshold * total / 2 - F.lit(1e-9)).cast("int")
    sized = names.where("clean <> ''").select("clean", _letters(F.col("clean")).alias("tokens"))
    # fewest common letters with a partner of any length
    sized = sized.withColumn("least", F.greatest(F.lit(1), F.ceil(n * (threshold / (2 - threshold)) - F.lit(1e-9)).cast("int")))
    first = lambda k, t: F.slice("tokens", 1, F.greatest(F.lit(0), n - t + k))
    rest = lambda p, i: F.slice(p, i + 2, F.size(p))
    pairs = lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(rest(p, i), lambda y: F.xxhash64(x, y))))

    def triples(p: Column) -> Column:
        after = lambda i, j: F.slice(p, i + j + 3, F.size(p))
        return F.flatten(F.transform(p, lambda x, i: F.flatten(F.transform(rest(p, i), lambda y, j: F.transform(after(i, j), lambda z: F.xxhash64(x, y, z))))))

    none = F.array().cast("array<bigint>")
    small, short = F.col("least"), n <= _LONG
    keys = F.concat(
        F.when(small == 1, first(1, small)).otherwise(none), F.when((small <= 2) & (n >= 2), pairs(first(2, F.greatest(small, F.lit(2))))).otherwise(none),
        F.when(short & (n >= 3), triples(first(3, F.greatest(small, F.lit(3))))).otherwise(none),
    )
    keyed = sized.select("clean", "tokens", F.explode(F.array_distinct(keys)).alias("key"))
    single = sized.where(n > _LONG * threshold / (2 - threshold)).select("clean", "tokens", F.explode(first(1, small)).alias("key"))

    def meet(one: DataFrame, two: DataFrame, which: Column) -> DataFrame:
        x, y = one.alias("x"), two.alias("y")
        enough = F.size(F.array_intersect("x.tokens", "y.tokens")) >= need(F.size("x.tokens") + F.size("y.tokens"))
        near = F.least(F.size("x.tokens"), F.size("y.tokens")) >= need(F.size("x.tokens") + F.size("y.tokens"))
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & which & near).where(enough)
        return met.select(F.least("x.clean", "y.clean").alias("a"), F.greatest("x.clean", "y.clean").alias("b"))

    ordered = F.col("x.clean") < F.col("y.clean")
    both_long = F.size("y.tokens") > _LONG
    far = meet(single.where(F.size("tokens") > _LONG), single, (F.col("x.clean") != F.col("y.clean")) & (~both_long | ordered))
    return meet(keyed, keyed, ordered).unionByName(far).distinct()


def identity_fuzzy(names: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs of similar names on different platforms (JN-8), each compared as its cleaned form.

    Cleaned forms (lower case, without ``@ _ . -`` and digits) are compared once
    however many names share them: see :func:`letter_candidates`, which loses no pair;
    an Arrow function scores the candidates, in both orders, since the measure
    depends on it.  Names are ordered by (name, platform).  Null names are left out;
    names with equal cleaned forms, also empty ones, have similarity 1.
    """
    from vigilspark.functions.udfs import username_similarity

    people = names.where("name is not null and platform is not null").select("name", "platform", F.regexp_replace(F.lower("name"), r"(?U)[@_.\-\d]", "").alias("clean"))
    people = people.distinct()
    found = letter_candidates(people.select("clean").distinct(), threshold)
    scored = found.select("a", "b", username_similarity("a", "b").alias("ab"), username_similarity("b", "a").alias("ba"))
    scored = scored.where((F.col("ab") >= threshold) | (F.col("ba") >= threshold))
    one = people.select(F.col("name").alias("n1"), F.col("platform").alias("p1"), F.col("clean").alias("a"))
    two = people.select(F.col("name").alias("n2"), F.col("platform").alias("p2"), F.col("clean").alias("b"))
    apart = scored.join(one, "a").join(two, "b").where("p1 <> p2")
    forth = F.struct("n1", "p1") < F.struct("n2", "p2")
    pick = lambda x, y: F.when(forth, F.col(x)).otherwise(F.col(y))
    apart = apart.select(pick("n1", "n2").alias("name_a"), pick("p1", "p2").alias("platform_a"), pick("n2", "n1").alias("name_b"), pick("p2", "p1").alias("platform_b"), pick("ab", "ba").alias("similarity"))
    equal = one.join(two, F.col("a") == F.col("b")).where((F.col("p1") != F.col("p2")) & forth)
    equal = equal.select(F.col("n1").alias("name_a"), F.col("p1").alias("platform_a"), F.col("n2").alias("name_b"), F.col("p2").alias("platform_b"), F.lit(1.0).alias("similarity"))
    base = lambda c: F.regexp_replace(F.lower(c), r"\d+$|_\w{1,4}$", "")
    return apart.where(F.col("similarity") >= threshold).unionByName(equal).select(
        "*", F.round(F.col("similarity") * 0.85, 4).alias("probability"), ((base("name_a") == base("name_b")) & (F.length(base("name_a")) >= 4)).alias("same_pattern")
    )


def identity_clusters(exact: DataFrame, fuzzy: DataFrame) -> DataFrame:
    """Exact and fuzzy identities as one table, clusters with equal value sets merged (DM-14, SE-7).

    (members, source, platforms, probability): ``members`` is the sorted distinct set
    of values; of several clusters with one set the exact one stays, else that of the
    smallest platforms, as one pre-aggregated row for each set.
    """
    pair = lambda a, b: F.array_join(F.array_sort(F.array_distinct(F.array(a, b))), ",")
    one = exact.select(F.array("value").alias("members"), F.lit("EXACT").alias("source"), F.col("platforms"), "probability")
    two = fuzzy.select(
        F.array_sort(F.array_distinct(F.array("name_a", "name_b"))).alias("members"), F.lit("FUZZY").alias("source"), pair("platform_a", "platform_b").alias("platforms"), "probability"
    )
    first = F.min(F.struct("source", "platforms", (-F.col("probability")).alias("minus")))
    kept = one.unionByName(two).groupBy("members").agg(first.alias("c"))
    return kept.select("members", "c.source", "c.platforms", (-F.col("c.minus")).alias("probability"))


def phash_pairs(images: DataFrame, bits: int = 4, bands: int = 6) -> DataFrame:
    """Pairs a < b of 64-bit hashes that differ in at most ``bits`` bits (JN-12), with their distance.

    Equal hashes are one class: its smallest id stands for it in pairs with other
    hashes, and each further id is paired with it at distance 0, so copies are not
    expanded into all pairs.  The 64 bits are cut into ``bands``; a pair within the
    distance is equal in at least ``bands`` - ``bits`` of them, so each choice of
    that many bands is an equi key (15 keys of 21 bits by default; more bands make
    more, rarer keys).  A pair is kept in the first choice it shares.
    """
    if bands <= bits:
        raise ValueError("more bands than bits are needed")
    edges = [64 * k // bands for k in range(bands + 1)]
    one = [sum(1 << i for i in range(edges[k], edges[k + 1])) for k in range(bands)]
    masks = [sum(one[k] for k in c) for c in combinations(range(bands), bands - bits)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    classes = images.where("id is not null and phash is not null").groupBy("phash").agg(F.min("id").alias("id"))
    parts = F.array(*[F.col("phash").bitwiseAND(F.lit(m)) for m in masks])
    keyed = classes.select("id", "phash", F.posexplode(parts).alias("choice", "part"))
    # sizes are estimated before the keys are exploded, so a broadcast would hold many times what was planned
    x, y = keyed.alias("x"), keyed.hint("merge").alias("y")
    pairs = x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.id") < F.col("y.id")))
    differ = F.col("x.phash").bitwiseXOR(F.col("y.phash"))
    earlier = reduce(lambda a, k: a | ((F.col("x.choice") > k) & (differ.bitwiseAND(F.lit(masks[k])) == 0)), range(len(masks) - 1), F.lit(False))
    apart = pairs.where((F.bit_count(differ) <= bits) & ~earlier).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.bit_count(differ).alias("distance"))
    copies = images.join(classes.select(F.col("id").alias("a"), "phash").hint("merge"), "phash").where("id > a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return apart.unionByName(copies)


def phash_all_pairs(images: DataFrame, bits: int = 4, bands: int = 6, block: int = BLOCK) -> DataFrame:
    """All pairs a < b of rows whose hashes differ in at most ``bits`` bits (JN-12), with their distance, copies included.

    The pairs of :func:`phash_pairs` between different hashes, and each hash with itself, are expanded to the rows that
    hold them.  A hash with many rows is dealt to blocks of about ``block``, and each pair of blocks
    is a key of its own, so no task makes more pairs than its blocks have.
    """
    known = images.where("id is not null and phash is not null").select("id", "phash")
    classes = materialize(known.groupBy("phash").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.count_distinct("id").alias("ids")), "classes")
    side = lambda x: classes.select(F.col("first").alias(x), F.col("phash").alias(f"h_{x}"), F.ceil(F.col("n") / block).alias(f"k_{x}"))
    near = phash_pairs(classes.select(F.col("first").alias("id"), "phash"), bits, bands)
    apart = near.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("h_a", "h_b", "k_a", "k_b", "distance")
    own = classes.where("ids > 1").select(F.col("phash").alias("h_a"), F.col("phash").alias("h_b"), *[F.ceil(F.col("n") / block).alias(k) for k in ("k_a", "k_b")], F.lit(0).alias("distance"))
    numbers = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    cells = apart.unionByName(own).withColumn("i", numbers("k_a")).withColumn("j", numbers("k_b"))
    dealt = known.join(classes.select("phash", F.ceil(F.col("n") / block).alias("k")).hint("merge"), "phash").select("id", "phash", F.pmod(F.xxhash64("id"), F.col("k")).alias("part"))
    one = dealt.select(F.col("phash").alias("h_a"), F.col("part").alias("i"), F.col("id").alias("x")).hint("merge")
    two = dealt.select(F.col("phash").alias("h_b"), F.col("part").alias("j"), F.col("id").alias("y")).hint("merge")
    met = cells.join(one, ["h_a", "i"]).join(two, ["h_b", "j"]).where((F.col("h_a") != F.col("h_b")) | (F.col("x") < F.col("y")))
    return met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def _greedy(edges: DataFrame) -> DataFrame:
    """(node) of those that repeat an earlier one, from edges (component, before, after).

    The edges of a component pass one task in order of ``after``: a node with a stored
    earlier neighbour is dropped, and only dropped nodes are remembered.
    """

    def run(batches):
        component, dropped, node, hit = None, set(), None, False
        for batch in batches:
            out = []
            for c, before, after in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, after) != (component, node):
                    if hit:
                        dropped.add(node)
                        out.append(node)
                    if c != component:
                        component, dropped = c, set()
                    node, hit = after, False
                hit = hit or before not in dropped
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["node"])
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64())], ["node"])

    ordered = edges.select("component", F.col("before").cast("long"), F.col("after").cast("long")).repartition("component")
    return ordered.sortWithinPartitions("component", "after", "before").mapInArrow(run, "node long")


def first_in_order(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(node) of the nodes that the greedy choice in order of nodes leaves out: those with a chosen smaller neighbour.

    ``edges``: (before, after) with before < after, distinct.  Components are found in
    rounds that grow with the logarithm of the longest chain; a component is
    then decided in one pass, of at most about ``most`` edges: of larger ones the first
    nodes are decided, what they rule out goes, and the rest follows.
    """
    comps = connected_components(edges, "before", "after")
    rest = materialize(edges.join(comps.select(F.col("node").alias("before"), "component").hint("merge"), "before").select("component", "before", "after"), "rest")
    found = None
    while True:
        sizes = rest.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = materialize(sizes, "large")
        last = large.isEmpty()
        if last:
            part = rest
        else:
            # a border for each large component: about ``most`` of its edges end at or before it
            steps = (0.0001, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
            at = F.percentile_approx("after", list(steps), 10_000)
            which = F.greatest(F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= most / F.col("n"))) - 1, F.lit(0))
            border = rest.join(large, "component").groupBy("component", "n").agg(at.alias("at"))
            border = materialize(border.select("component", F.get("at", which).alias("border")), "border")
            joined = rest.join(border, "component", "left")
            part = joined.where("border is null or after <= border").select("component", "before", "after")
        dropped = materialize(_greedy(part), "dropped")
        found = dropped if found is None else found.unionByName(dropped)
        if last:
            return found
        ahead = joined.where("after > border").join(dropped.select(F.col("node").alias("before")), "before", "left_anti")
        ahead = materialize(ahead.select("component", "before", "after", (F.col("before") <= F.col("border")).alias("decided")), "ahead")
        # later nodes with a chosen neighbour among the decided ones
        ruled = materialize(ahead.where("decided").select(F.col("after").alias("node")).distinct(), "ruled")
        found = found.unionByName(ruled)
        rest = ahead.where("not decided").join(ruled.select(F.col("node").alias("after")), "after", "left_anti")
        rest = materialize(rest.join(ruled.select(F.col("node").alias("before")), "before", "left_anti").select("component", "before", "after"), "rest")


def first_seen_fuzzy(posts: DataFrame, order: str = "id", hash_col: str = "phash", bits: int = 4, most: int = 2_000_000) -> DataFrame:
    """First-seen deduplication by near hashes: (post columns, duplicate, canonical).

    In the order of ``order`` (distinct), a post whose hash is within ``bits`` of a
    stored one repeats the first such post and is not stored; others are stored.
    Null hashes are stored and match nothing.  See :func:`first_in_order`.
    """
    classes = posts.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(order).alias("node"))
    edges = materialize(phash_pairs(classes.select(F.col("node").alias("id"), F.col(hash_col).alias("phash")), bits).select(F.col("a").alias("before"), F.col("b").alias("after")), "near")
    dropped = materialize(first_in_order(edges, most), "dropped")
    # ids pack well in Parquet, so file sizes say little about a broadcast: both sides are exchanged
    kept_before = edges.join(dropped.select(F.col("node").alias("before")).hint("merge"), "before", "left_anti")
    first = kept_before.join(dropped.select(F.col("node").alias("after")).hint("merge"), "after", "left_semi").groupBy(F.col("after").alias("node")).agg(F.min("before").alias("first"))
    by_hash = classes.join(first.hint("merge"), "node", "left").select(hash_col, F.coalesce("first", "node").alias("canonical"))
    out = posts.join(by_hash.hint("merge"), hash_col, "left")
    repeat = F.col("canonical").isNotNull() & (F.col("canonical") != F.col(order))
    return out.select(*posts.columns, F.when(repeat, F.col("canonical")).alias("canonical"), repeat.alias("duplicate"))


def dedup_posts(posts: DataFrame, bits: int = 4, most: int = 2_000_000) -> DataFrame:
    """First-seen deduplication by address, near image hash and text, one after the other (WN-4): (id, duplicate, signal, canonical).

    ``posts``: (id, url, phash, text), ids distinct and in order of arrival.  A post that
    repeats an address registers nothing more; one that passes competes with
    its image hash, and one that passes that too with the first 200 characters of
    its text.  Null and empty signals never match.  ``canonical`` is the first eight hex
    digits of the SHA-256 of the repeated address or text, or the id of the first
    stored post with a near image.
    """
    key = lambda c: F.when(c.isNotNull() & (c != ""), F.sha2(c.cast("binary"), 256))
    rows = materialize(posts.select("id", key(F.col("url")).alias("url"), F.col("phash").cast("long"), key(F.substring("text", 1, 200)).alias("content")), "posts")

    def repeats(some: DataFrame, signal: str) -> DataFrame:
        first = some.where(F.col(signal).isNotNull()).groupBy(signal).agg(F.min("id").alias("first"))
        return some.join(first, signal, "left").withColumn("again", F.coalesce(F.col("id") > F.col("first"), F.lit(False)))

    said = lambda df, signal, canonical: df.select("id", F.lit(True).alias("duplicate"), F.lit(signal).alias("signal"), canonical.alias("canonical"))
    by_url = materialize(repeats(rows, "url").select("id", "url", "phash", "content", "again"), "by_url")
    by_image = materialize(first_seen_fuzzy(by_url.where("not again").select("id", "phash", "content"), "id", "phash", bits, most), "by_image")
    by_text = repeats(by_image.where("not duplicate").select("id", "content"), "content")
    found = said(by_url.where("again"), "url", F.substring("url", 1, 8)).unionByName(said(by_image.where("duplicate"), "phash", F.col("canonical").cast("string")))
    found = found.unionByName(said(by_text.where("again"), "content", F.substring("content", 1, 8)))
    unique = by_text.where("not again").select("id", F.lit(False).alias("duplicate"), F.lit(None).cast("string").alias("signal"), F.lit(None).cast("string").alias("canonical"))
    return found.unionByName(unique)


def first_seen_cascade(posts: DataFrame, signals: list[str], order: str) -> DataFrame:
    """First-seen deduplication by several signals in turn (WN-4, H3).

    A post that repeats the first signal registers nothing; one that passes it
    competes on the next signal among the posts that passed. Null and empty
    signals never match. Gives (post columns, duplicate, reason, canonical).
    """
    out = posts.withColumn("reason", F.lit(None).cast("string")).withColumn("canonical", F.lit(None).cast("long"))
    for signal in signals:
        usable = F.col("reason").isNull() & F.col(signal).isNotNull() & (F.col(signal) != "")
        # the smallest of each key is pre-aggregated map-side, so a frequent key is one row for each task
        first = out.where(usable).groupBy(F.col(signal).alias("_key")).agg(F.min(order).alias("_first"))
        joined = out.join(first, F.col(signal) == F.col("_key"), "left")
        repeat = usable & (F.col(order) > F.col("_first"))
        out = joined.withColumns(
            {"canonical": F.when(repeat, F.col("_first")).otherwise(F.col("canonical")), "reason": F.when(repeat, F.lit(signal)).otherwise(F.col("reason"))}
        ).drop("_key", "_first")
    return out.withColumn("duplicate", F.col("reason").isNotNull())


def unseen(new: DataFrame, seen: DataFrame, key: Column, alias: str) -> DataFrame:
    """Rows whose key has not been seen (JN-16): an anti join."""
    return new.withColumn(alias, key).join(seen.select(alias).distinct(), alias, "left_anti")
