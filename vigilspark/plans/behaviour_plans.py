"""Queries on channel behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.operators import behaviour as B
from vigilspark.plans.testbed import PAYMENTS, payment_entities, CHANNEL_ENTITIES, POSTS, TEXTS, channel_entities, channel_posts, channel_texts, sql_any

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _bins(index, n):
    return ", ".join(f"count(*) FILTER (WHERE {index} = {i}) AS b{i}" for i in range(n))


def _entropy(n):
    total = " + ".join(f"b{i}" for i in range(n))
    parts = " + ".join(f"CASE WHEN b{i} > 0 THEN -(b{i} / ({total})) * log2(b{i} / ({total})) ELSE 0 END" for i in range(n))
    return f"CASE WHEN ({total}) > 0 THEN round(({parts}) / log2({n}.0), 4) ELSE 0.0 END"


@query(f"""WITH {POSTS}, h AS (SELECT channel, {_bins("hour(ts)", 24)}, count(*) AS n FROM posts WHERE ts IS NOT NULL GROUP BY 1)
  SELECT channel, array_to_string([{", ".join(f"printf('%.6f', round(b{i} / n, 6))" for i in range(24))}], ',') AS schedule FROM h""")
def posting_schedule(spark, sf_dir):
    s = B.posting_schedule(channel_posts(spark, sf_dir))
    return s.select("channel", F.array_join(F.transform("schedule", lambda x: F.format_string("%.6f", x)), ",").alias("schedule"))


@query(f"""WITH {POSTS}, h AS (SELECT channel, {_bins("hour(ts)", 24)} FROM posts WHERE ts IS NOT NULL GROUP BY 1),
  l AS (SELECT *, [{", ".join(f"b{i}" for i in range(24))}] AS hs FROM h)
  SELECT channel, {_entropy(24)} AS hours_entropy, CAST(list_position(hs, list_max(hs)) - 1 AS DOUBLE) AS peak_hour FROM l""")
def hours_entropy(spark, sf_dir):
    return B.posting_schedule(channel_posts(spark, sf_dir)).select("channel", "hours_entropy", "peak_hour")


@query(f"WITH {POSTS}, d AS (SELECT channel, {_bins('(isodow(ts) - 1)', 7)} FROM posts WHERE ts IS NOT NULL GROUP BY 1) SELECT channel, {_entropy(7)} AS days_entropy FROM d")
def days_entropy(spark, sf_dir):
    return B.day_entropy(channel_posts(spark, sf_dir))


DAILY = f"""WITH {POSTS}, daily AS (SELECT channel, CAST(ts AS DATE) AS day, count(*) AS n, min(ts) AS t0, max(ts) AS t1 FROM posts GROUP BY 1, 2),
  g AS (SELECT channel, avg(n) AS m, stddev_pop(n) AS sd, count(*) AS days, CAST(sum(n) AS BIGINT) AS posts,
    CAST(floor((epoch_us(max(t1)) - epoch_us(min(t0))) / 86400000000) AS BIGINT) AS span FROM daily GROUP BY 1)"""


@query(f"""{DAILY} SELECT channel, posts, round(m, 2) AS posts_per_day_mean, round(sd, 2) AS posts_per_day_std,
    CASE WHEN posts < 2 THEN 0 ELSE greatest(1, span) END AS observation_days, round(posts / greatest(1, span), 2) AS posting_frequency FROM g""")
def posting_frequency(spark, sf_dir):
    return B.daily_rhythm(channel_posts(spark, sf_dir)).drop("regularity")


@query(f"{DAILY} SELECT channel, CASE WHEN days < 2 THEN 0.0 ELSE round(greatest(0.0, 1 - sd / greatest(m, 1e-6)), 4) END AS regularity FROM g")
def regularity(spark, sf_dir):
    return B.daily_rhythm(channel_posts(spark, sf_dir)).select("channel", "regularity")


@query(f"""WITH {POSTS}, h AS (SELECT channel, date_trunc('hour', ts) AS h, count(*) AS n FROM posts GROUP BY 1, 2)
  SELECT channel, round(max(n) / greatest(avg(n), 1.0), 2) AS burst FROM h GROUP BY 1""")
def burst_score(spark, sf_dir):
    return B.burst(channel_posts(spark, sf_dir))


@query(f"""WITH {POSTS}, g AS (SELECT channel, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel ORDER BY ts, message_id)) / 3600000000 AS gap FROM posts)
  SELECT channel, round(least(coalesce(max(gap), 0.0), 720.0) / 720, 4) AS silence FROM g GROUP BY 1""")
def silence_gap(spark, sf_dir):
    return B.silence(channel_posts(spark, sf_dir))


@query(f"""WITH {POSTS}, g AS (SELECT channel, count(nullif(message_id, 0)) AS ids, max(nullif(message_id, 0)) - min(nullif(message_id, 0)) + 1 AS span FROM posts GROUP BY 1)
  SELECT channel, CASE WHEN ids < 2 THEN 0.0 ELSE round(1 - ids / span, 4) END AS deletion_rate FROM g""")
def deletion_rate(spark, sf_dir):
    return B.counters(channel_posts(spark, sf_dir)).select("channel", "deletion_rate")


@query(f"""WITH {POSTS} SELECT channel, round(avg((reactions + forwards + replies) / CASE WHEN views = 0 THEN 1 ELSE views END), 6) AS engagement,
    round(avg(views) FILTER (WHERE views > 0), 4) AS mean_views, round(100 * count(*) FILTER (WHERE media = 'images') / count(*), 2) AS images_per_100,
    round(100 * count(*) FILTER (WHERE media = 'videos') / count(*), 2) AS videos_per_100, round(100 * count(*) FILTER (WHERE media = 'links') / count(*), 2) AS links_per_100,
    round(avg(forwards), 3) AS forward_ratio FROM posts GROUP BY 1""")
def engagement(spark, sf_dir):
    return B.counters(channel_posts(spark, sf_dir)).drop("deletion_rate")


def _hits(words):
    return " + ".join("CAST(contains(lower(text), '" + w.replace("'", "''") + "') AS INTEGER)" for w in words)


@query(f"""WITH {TEXTS} SELECT channel, count(*) AS n_texts, round(sum({_hits(X.URGENCY_FULL)}) / count(*) * 100, 2) AS urgency_density,
    round(avg(CAST({sql_any('text', X.URGENCY_FULL)} AS INTEGER)), 4) AS urgency_share, count(*) FILTER (WHERE {sql_any('text', X.BACKUP_FULL)}) AS backup_mentions,
    round(sum(len(regexp_extract_all(text, '{X.EMOJI}'))) / sum(length(text)) * 100, 4) AS emoji_density, round(avg(length(text)) FILTER (WHERE text <> ''), 4) AS avg_length
  FROM texts GROUP BY 1""")
def urgency_density(spark, sf_dir):
    return B.text_features(channel_texts(spark, sf_dir), X.URGENCY_FULL, X.BACKUP_FULL, X.EMOJI)


@query(f"""WITH {TEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY message_id) AS n FROM texts)
  SELECT channel, count(*) AS n_texts, round(avg(CAST({sql_any('text', X.URGENCY_EVIDENCE)} AS INTEGER)), 4) AS urgency_share FROM r WHERE n <= 100 GROUP BY 1""")
def urgency_first_hundred(spark, sf_dir):
    """Share of urgent posts among the first hundred of each channel (AG-34, WN-10)."""
    return B.text_features(channel_texts(spark, sf_dir), X.URGENCY_EVIDENCE, X.BACKUP_EVIDENCE, X.EMOJI, first=100).select("channel", "n_texts", "urgency_share")


@query(f"""WITH {TEXTS}, l AS (SELECT channel, CASE WHEN d + l = 0 THEN 'unknown' WHEN d / (d + l) > 0.6 THEN 'hindi' WHEN d / (d + l) > 0.2 THEN 'hinglish' ELSE 'english' END AS language
    FROM (SELECT channel, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM texts))
  SELECT channel, language, round(count(*) / sum(count(*)) OVER (PARTITION BY channel), 3) AS share FROM l GROUP BY 1, 2""")
def language_distribution(spark, sf_dir):
    """Share of each detected language in a channel (AG-11)."""
    from pyspark.sql import Window as W

    from vigilspark.functions.text import script_language

    counts = channel_texts(spark, sf_dir).groupBy("channel", script_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))
    return counts.select("channel", "language", F.round(F.col("n") / F.sum("n").over(W.partitionBy("channel")), 3).alias("share"))


@query(f"""WITH {POSTS}, e AS (SELECT channel, arg_min(views, ts) AS s0, arg_max(views, ts) AS s1, min(ts) AS d0, max(ts) AS d1, count(*) AS n FROM posts GROUP BY 1)
  SELECT channel, CASE WHEN n < 2 THEN 0.0 ELSE round((s1 - s0) / greatest((epoch_us(d1) - epoch_us(d0)) / 86400000000, 1.0), 2) END AS growth_rate FROM e""")
def subscriber_growth(spark, sf_dir):
    snaps = channel_posts(spark, sf_dir).select("channel", F.col("ts").alias("date"), F.col("views").alias("subscribers"))
    return B.growth_per_day(snaps)


@query(f"WITH {PAYMENTS} SELECT * FROM pd")
def payment_diversity(spark, sf_dir):
    return B.entity_counts(payment_entities(spark, sf_dir))


def _fingerprint_sql():
    return f"""WITH {POSTS}, {TEXTS}, {PAYMENTS},
  h AS (SELECT channel, {_bins("hour(ts)", 24)} FROM posts GROUP BY 1), h2 AS (SELECT channel, {_entropy(24)} AS v1, list_position([{", ".join(f"b{i}" for i in range(24))}], greatest({", ".join(f"b{i}" for i in range(24))})) - 1 AS peak FROM h),
  d AS (SELECT channel, {_bins("(isodow(ts) - 1)", 7)} FROM posts GROUP BY 1), d2 AS (SELECT channel, {_entropy(7)} AS v2 FROM d),
  daily AS (SELECT channel, CAST(ts AS DATE) AS day, count(*) AS n FROM posts GROUP BY 1, 2), day2 AS (SELECT channel, round(avg(n), 2) AS m, round(stddev_pop(n), 2) AS sd,
    CASE WHEN count(*) < 2 THEN 0.0 ELSE round(greatest(0.0, 1 - stddev_pop(n) / greatest(avg(n), 1e-6)), 4) END AS reg FROM daily GROUP BY 1),
  hr AS (SELECT channel, date_trunc('hour', ts) AS h, count(*) AS n FROM posts GROUP BY 1, 2), b AS (SELECT channel, round(max(n) / greatest(avg(n), 1.0), 2) AS burst FROM hr GROUP BY 1),
  gp AS (SELECT channel, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY channel ORDER BY ts, message_id)) / 3600000000 AS gap FROM posts),
  s AS (SELECT channel, round(least(coalesce(max(gap), 0.0), 720.0) / 720, 4) AS silence FROM gp GROUP BY 1),
  c AS (SELECT channel, CASE WHEN count(nullif(message_id, 0)) < 2 THEN 0.0 ELSE round(1 - count(nullif(message_id, 0)) / (max(nullif(message_id, 0)) - min(nullif(message_id, 0)) + 1), 4) END AS del,
    round(avg((reactions + forwards + replies) / CASE WHEN views = 0 THEN 1 ELSE views END), 6) AS eng, coalesce(round(avg(views) FILTER (WHERE views > 0), 4), 0.0) AS mv,
    round(100 * count(*) FILTER (WHERE media = 'images') / count(*), 2) + round(100 * count(*) FILTER (WHERE media = 'videos') / count(*), 2) AS im, round(100 * count(*) FILTER (WHERE media = 'links') / count(*), 2) AS li, round(avg(forwards), 3) AS fw FROM posts GROUP BY 1),
  t AS (SELECT channel, round(sum({_hits(X.URGENCY_FULL)}) / count(*) * 100, 2) AS urg, count(*) FILTER (WHERE {sql_any('text', X.BACKUP_FULL)}) AS bak,
    round(sum(len(regexp_extract_all(text, '{X.EMOJI}'))) / sum(length(text)) * 100, 4) AS emo, round(avg(length(text)) FILTER (WHERE text <> ''), 4) AS al FROM texts GROUP BY 1),
  lg AS (SELECT channel, round(count(*) FILTER (WHERE l = 'hindi') / count(*), 3) AS hi, round(count(*) FILTER (WHERE l = 'english') / count(*), 3) AS en, round(count(*) FILTER (WHERE l = 'hinglish') / count(*), 3) AS mix
    FROM (SELECT channel, CASE WHEN d + l = 0 THEN 'unknown' WHEN d / (d + l) > 0.6 THEN 'hindi' WHEN d / (d + l) > 0.2 THEN 'hinglish' ELSE 'english' END AS l
    FROM (SELECT channel, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM texts)) GROUP BY 1),
  qr AS (SELECT channel, round(sum(len(regexp_extract_all(text, '{X.QR_MENTION}'))) / count(*) * 100, 4) AS qr FROM texts GROUP BY 1),
  lk AS (SELECT channel, count(DISTINCT link) AS linked FROM (SELECT channel, unnest(list_concat(list_transform(regexp_extract_all(text, '{X.TELEGRAM_LINK}', 1), lambda x: 't.me/' || x),
    list_transform(list_filter(regexp_extract_all(text, '{X.TELEGRAM_MENTION}', 1), lambda x: lower(x) NOT IN ('gmail', 'yahoo', 'hotmail', 'email')), lambda x: '@' || x))) AS link FROM texts) GROUP BY 1),
  sn AS (SELECT channel, arg_min(views, ts) AS s0, arg_max(views, ts) AS s1, CASE WHEN count(*) < 2 THEN 0.0 ELSE round((arg_max(views, ts) - arg_min(views, ts)) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000, 1.0), 2) END AS grow FROM posts GROUP BY 1),
  v AS (SELECT channel, [v1, v2, m, sd, burst, silence, peak / 24, reg, coalesce(hi, 0), coalesce(en, 0), coalesce(mix, 0), coalesce(al, 0) / 1000, coalesce(urg, 0), coalesce(emo, 0), fw, im / 100, li / 100, coalesce(linked, 0) / 50, coalesce(bak, 0) / 10, del,
    coalesce(upis, 0) / 20, coalesce(phones, 0) / 20, coalesce(urls, 0) / 50, coalesce(qr, 0), coalesce(payment_diversity, 0),
    least(grow / 100, 1.0), CASE WHEN s1 > 0 THEN least(mv / s1, 5.0) ELSE 0.0 END, eng]::DOUBLE[] AS vec FROM h2 JOIN d2 USING (channel) JOIN day2 USING (channel) JOIN b USING (channel) JOIN s USING (channel) JOIN c USING (channel)
    LEFT JOIN t USING (channel) LEFT JOIN pd USING (channel) LEFT JOIN lg USING (channel) LEFT JOIN qr USING (channel) LEFT JOIN lk USING (channel) LEFT JOIN sn USING (channel))
  SELECT channel, {", ".join(f"round(vec[{i}], 4) AS f{i:02d}" for i in range(1, 29))} FROM v"""


@query(_fingerprint_sql())
def fingerprint28(spark, sf_dir):
    snaps = channel_posts(spark, sf_dir).select("channel", F.col("ts").alias("date"), F.col("views").alias("subscribers"))
    vector = B.fingerprint(channel_posts(spark, sf_dir), channel_texts(spark, sf_dir), payment_entities(spark, sf_dir), snaps)
    return vector.select("channel", *[F.col("vector")[i].alias(f"f{i + 1:02d}") for i in range(28)])
