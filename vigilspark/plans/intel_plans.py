"""Queries on evidence, decisions, graph, evaluation and logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import scores as S
from vigilspark.functions import text as T
from vigilspark.operators import behaviour as B
from vigilspark.operators import evaluation as E
from vigilspark.operators import intel as I
from vigilspark.operators import linking as L
from vigilspark.plans.link_plans import BLOCKED, blocklist
from vigilspark.plans.testbed import CHANNEL_ENTITIES, ENTITIES, POSTS, TEXTS, channel_entities, channel_posts, channel_texts, entities, read, sql_any
from vigilspark.plans.text_plans import CLAIMS, claims, rule_hits_sql
from vigilspark.sources import keyed_table
from vigilspark.storage import new_path

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def channel_claims(spark, sf_dir):
    """Posts of channels with words of every family: the claims, by author."""
    return claims(spark, sf_dir).select(F.col("author").alias("channel"), F.col("id").alias("message_id"), "text")


_PROMISE = ", ".join(f"nullif(regexp_extract(text, '{p}', 0), '')" for p in X.FINANCIAL_PROMISES)
def _whole(sql):
    """The same SQL over all texts of a channel."""
    for cut in (" WHERE nth <= 200", " WHERE k <= 100"):
        sql = sql.replace(cut, "")
    return sql


MARKS = f"""{CLAIMS}, numbered AS (SELECT author AS channel, id, text, row_number() OVER (PARTITION BY author ORDER BY id, text) AS nth FROM claims),
  told AS (SELECT channel, string_agg(lower(text), ' ' ORDER BY nth) AS text FROM numbered WHERE nth <= 200 GROUP BY 1),
  rules AS (SELECT channel, text, {", ".join(f"{rule_hits_sql(p)} AS h{k}" for k, (_, p) in enumerate(X.RULE_PATTERNS))} FROM told),
  marks AS (SELECT channel, CASE WHEN NOT {sql_any('text', X.SCAM_CONTEXT)} THEN '' {" ".join(f"WHEN contains(text, '{w}') THEN '{who}'" for w, who in X.IMPERSONATION)} ELSE '' END AS impersonated,
    substr(coalesce({_PROMISE}, ''), 1, 80) AS promise, CASE WHEN greatest({", ".join(f"h{k}" for k in range(len(X.RULE_PATTERNS)))}) < 2 THEN 'UNKNOWN'
    {" ".join(f"WHEN h{k} = greatest({', '.join(f'h{j}' for j in range(len(X.RULE_PATTERNS)))}) THEN '{n}'" for k, (n, _) in enumerate(X.RULE_PATTERNS))} END AS category FROM rules)"""


@query(f"WITH {MARKS} SELECT * FROM marks")
def content_marks(spark, sf_dir):
    """Impersonation, promise and category of channels from their texts (DM-4)."""
    return I.content_marks(channel_claims(spark, sf_dir))


def _items(spark, sf_dir, whole=False):
    """``whole``: from all texts of a channel, else texts are judged by the first 100 and marks by the first 200 of it."""
    met = L.values_met(channel_entities(spark, sf_dir), blocklist(spark, sf_dir))
    told = channel_claims(spark, sf_dir)
    texts = B.text_features(told, X.URGENCY_EVIDENCE, X.BACKUP_EVIDENCE, X.EMOJI, first=None if whole else 100).select("channel", "backup_mentions", "urgency_share")
    features = B.counters(channel_posts(spark, sf_dir)).select("channel", "deletion_rate").join(texts, "channel", "full")
    content = I.content_marks_whole(told) if whole else I.content_marks(told)
    return I.evidence_items(met, features, content)


ITEMS = f"""{CHANNEL_ENTITIES}, {BLOCKED}, {POSTS}, {TEXTS}, {MARKS}, held AS (SELECT entity_type, value, count(*) AS n FROM channel_entities GROUP BY 1, 2 HAVING count(*) >= 2),
  firsts AS (SELECT author AS channel, text, row_number() OVER (PARTITION BY author ORDER BY id) AS k FROM claims),
  tf AS (SELECT channel, count(*) FILTER (WHERE {sql_any('text', X.BACKUP_EVIDENCE)}) AS bak, round(avg(CAST({sql_any('text', X.URGENCY_EVIDENCE)} AS INTEGER)), 4) AS urg FROM firsts WHERE k <= 100 GROUP BY 1),
  del AS (SELECT channel, CASE WHEN count(nullif(message_id, 0)) < 2 THEN 0.0 ELSE round(1 - count(nullif(message_id, 0)) / (max(nullif(message_id, 0)) - min(nullif(message_id, 0)) + 1), 4) END AS d FROM posts GROUP BY 1),
  chans AS (SELECT channel FROM channel_entities UNION SELECT channel FROM posts UNION SELECT channel FROM texts UNION SELECT author FROM claims),
  items AS (SELECT channel, 'BLOCKLIST_MATCH' AS evidence_type, 'blocklist' AS source, value, 'DEFINITIVE' AS strength FROM channel_entities JOIN blocked USING (entity_type, value)
    UNION ALL SELECT channel, 'SHARED_ENTITY', 'entity_sharing', value, CASE WHEN entity_type <> 'URL' AND n >= 3 THEN 'STRONG' ELSE 'MODERATE' END FROM channel_entities JOIN held USING (entity_type, value)
    UNION ALL SELECT channel, 'DELETION_PATTERN', 'message_id_analysis', CAST(d AS VARCHAR), 'WEAK' FROM del WHERE d > 0.3
    UNION ALL SELECT channel, 'BACKUP_CHANNEL_MENTION', 'text_analysis', CAST(bak AS VARCHAR), 'MODERATE' FROM tf WHERE bak > 0
    UNION ALL SELECT channel, 'URGENCY_PRESSURE', 'text_analysis', CAST(urg AS VARCHAR), 'CIRCUMSTANTIAL' FROM tf WHERE urg > 0.15
    UNION ALL SELECT channel, 'IMPERSONATION_DETECTED', 'text_pattern_match', impersonated, 'MODERATE' FROM marks WHERE impersonated <> ''
    UNION ALL SELECT channel, 'FINANCIAL_PROMISE', 'text_pattern_match', promise, 'WEAK' FROM marks WHERE promise <> ''
    UNION ALL SELECT channel, 'SCAM_CATEGORY_MATCH', 'rule_based_classifier', category, 'CIRCUMSTANTIAL' FROM marks WHERE category <> 'UNKNOWN')"""


@query(_whole(f"WITH {ITEMS} SELECT * FROM items"))
def evidence_items(spark, sf_dir):
    return _items(spark, sf_dir, whole=True)


def _observed(spark, sf_dir):
    """(channel, populated, n_posts): what is there of every channel that posts, tells something or shows an entity."""
    # whether a channel shows an entity needs no distinct entities
    ce, events = entities(spark, sf_dir).select("channel"), channel_posts(spark, sf_dir).select("channel", "ts", "media", "views")
    texts = channel_texts(spark, sf_dir).select("channel", "text").unionByName(channel_claims(spark, sf_dir).select("channel", "text"))
    posts = events.unionByName(texts.select("channel", F.lit(None).cast(events.schema["ts"].dataType).alias("ts"), F.lit("none").alias("media"), F.lit(0).cast("long").alias("views")))
    chans = ce.select("channel").unionByName(posts.select("channel")).distinct()
    known = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("channel"))
    return I.populated_fields(chans, posts, texts, ce, known)


CONFIDENCE = f"""{ITEMS}, tx AS (SELECT channel, text FROM texts UNION ALL SELECT author, text FROM claims),
  allp AS (SELECT channel, ts, media, views FROM posts UNION ALL SELECT channel, NULL, 'none', 0 FROM tx),
  pa AS (SELECT channel, count(*) AS n, count(ts) AS timed, count(*) FILTER (WHERE media <> 'none') AS shown, count(*) FILTER (WHERE views > 0) AS snaps FROM allp GROUP BY 1),
  obs AS (SELECT c.channel, coalesce(n, 0) AS n_posts, CAST(coalesce(n, 0) > 0 AS INTEGER) + CAST(c.channel IN (SELECT channel FROM channel_entities) AS INTEGER) + CAST(c.channel IN (SELECT s_suppkey FROM supplier) AS INTEGER) + CAST(coalesce(timed, 0) > 0 AS INTEGER)
    + CAST(c.channel IN (SELECT channel FROM tx WHERE text <> '') AS INTEGER) + CAST(coalesce(shown, 0) > 0 AS INTEGER) + CAST(coalesce(snaps, 0) >= 2 AS INTEGER) AS populated FROM chans c LEFT JOIN pa USING (channel)),
  bs AS (SELECT channel, strength, count(*) AS n FROM items GROUP BY 1, 2), src AS (SELECT channel, count(DISTINCT source) AS sources FROM items GROUP BY 1),
  gs AS (SELECT channel, CAST(sum(n) AS BIGINT) AS n_items, max(n) AS top, max(CASE strength {" ".join(f"WHEN '{s}' THEN {r}" for s, r in X.STRENGTH_RANK)} END) AS rank FROM bs GROUP BY 1),
  m AS (SELECT channel, n_posts, populated / 7 AS comp, coalesce(top / n_items, 0.0) AS agr, CAST(coalesce(sources, 0) AS INTEGER) AS sources, coalesce(n_items, 0) AS n_items, CAST(coalesce(rank, 0) AS INTEGER) AS rank,
    round(pow(greatest(populated / 7, 0.01) * CASE WHEN n_items > 0 THEN 1.0 ELSE 0.1 END * greatest(coalesce(top / n_items, 0.0), 0.01), 1.0 / 3), 4) AS mean FROM obs LEFT JOIN gs USING (channel) LEFT JOIN src USING (channel)),
  o AS (SELECT channel, n_posts, round(comp, 4) AS completeness, round(agr, 4) AS agreement, sources, n_items, rank, round(least(CASE WHEN n_posts < 20 THEN mean * 0.5 ELSE mean END, 0.99), 6) AS overall FROM m),
  conf AS (SELECT *, CASE WHEN overall >= 0.6 AND n_posts >= 100 AND sources >= 2 THEN 'HIGH' WHEN overall >= 0.35 AND n_posts >= 20 THEN 'MODERATE' WHEN overall >= 0.15 THEN 'LOW' ELSE 'INSUFFICIENT' END AS confidence_class FROM o)"""


@query(f"WITH {CONFIDENCE} SELECT * FROM conf")
def confidence(spark, sf_dir):
    return I.confidence(_observed(spark, sf_dir), _items(spark, sf_dir))


RECOMMENDED = f"""{CONFIDENCE}, act AS (SELECT *, CASE WHEN rank = 5 AND confidence_class IN ('HIGH', 'MODERATE') THEN 'TAKEDOWN_REQUEST' WHEN rank >= 4 AND confidence_class IN ('HIGH', 'MODERATE') THEN 'PRIORITY_INVESTIGATION'
    WHEN rank >= 3 THEN 'ANALYST_REVIEW' WHEN rank >= 2 THEN 'AUTOMATED_MONITORING' ELSE 'NO_ACTION' END AS action,
    CASE WHEN rank = 5 AND confidence_class = 'HIGH' THEN 'IMMEDIATE' WHEN rank >= 4 AND confidence_class IN ('HIGH', 'MODERATE') THEN '24_HOURS' WHEN rank >= 3 THEN 'ROUTINE' ELSE 'DEFERRED' END AS urgency FROM conf),
  sup AS (SELECT *, CASE WHEN action = 'TAKEDOWN_REQUEST' AND confidence_class IN ('LOW', 'INSUFFICIENT') THEN 'CONFIDENCE' WHEN n_items > 0 AND rank = 1 AND action NOT IN ('NO_ACTION', 'AUTOMATED_MONITORING') THEN 'CIRCUMSTANTIAL'
    WHEN sources < 2 AND action IN ('TAKEDOWN_REQUEST', 'PRIORITY_INVESTIGATION') THEN 'SOURCES' WHEN completeness < 0.4 AND action NOT IN ('NO_ACTION', 'AUTOMATED_MONITORING') THEN 'COMPLETENESS'
    WHEN n_posts < 5 AND action NOT IN ('NO_ACTION', 'AUTOMATED_MONITORING') THEN 'POSTS' ELSE '' END AS suppression FROM act),
  rec AS (SELECT *, CASE WHEN suppression <> '' THEN 'SUPPRESSED' ELSE action END AS final_action FROM sup)"""


def _recommended(spark, sf_dir, whole=False):
    return I.recommendation(I.confidence(_observed(spark, sf_dir), _items(spark, sf_dir, whole)))


@query(f"WITH {RECOMMENDED} SELECT channel, rank, confidence_class, action, urgency, suppression, final_action FROM rec")
def recommendation(spark, sf_dir):
    return _recommended(spark, sf_dir).select("channel", "rank", "confidence_class", "action", "urgency", "suppression", "final_action")


@query(f"""WITH {RECOMMENDED} SELECT final_action, count(*) AS n, count(*) FILTER (WHERE suppression <> '') AS suppressed, round(count(*) FILTER (WHERE urgency = 'IMMEDIATE') / greatest(count(*), 1), 4) AS immediate_share FROM rec GROUP BY 1""")
def recommendation_summary(spark, sf_dir):
    """Recommendations by action (AG-6, SC-9)."""
    n = F.count("*")
    return _recommended(spark, sf_dir).groupBy("final_action").agg(
        n.alias("n"), F.count_if(F.col("suppression") != "").alias("suppressed"), F.round(S.ratio(F.count_if(F.col("urgency") == "IMMEDIATE"), n), 4).alias("immediate_share")
    )


def _role_sql():
    # fragments of common words, so that the invented prose of the test tables meets some indicators
    hits = {name: " + ".join(f"max(CAST(contains(lower(text), '{w.lower()}') AS INTEGER))" for w in words) for name, _, words in X.ROLES}
    cols = ", ".join(f"({h}) AS {n}" for n, h in hits.items())
    best = "greatest(" + ", ".join(f"{n} * {w}" for n, w, _ in X.ROLES) + ")"
    case = " ".join(f"WHEN {n} * {w} = best THEN '{n}'" for n, w, _ in X.ROLES)
    return f"""WITH m AS (SELECT CAST(conv_id AS VARCHAR) || ':' || role AS "user", text || CASE WHEN turn % 3 = 1 THEN ' join now and send amount by gpay 9876543210' WHEN turn % 3 = 2 THEN ' forward this, share karo' ELSE '' END AS text FROM conversations),
  g AS (SELECT "user", {cols}, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '{X.ROLE_ENTITY}')) AS e FROM m GROUP BY 1), b AS (SELECT *, {best}::DOUBLE AS best FROM g)
  SELECT "user", CASE WHEN best <= 0 THEN 'UNKNOWN' {case} END AS role, CASE WHEN best > 0 THEN round(least(0.95, 0.4 + best * 0.1), 4) ELSE 0.3 END::DOUBLE AS confidence,
    round((least(100.0, n * 2.0) + least(20.0, e * 3.0))::DOUBLE, 1) AS activity FROM b"""


@query(_role_sql())
def role_attribution(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    more = F.when(F.col("turn") % 3 == 1, " join now and send amount by gpay 9876543210").when(F.col("turn") % 3 == 2, " forward this, share karo").otherwise("")
    return I.roles(c.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("role")).alias("user"), F.concat("text", more).alias("text")))


APPEAR = "app AS (SELECT event_id AS id, user_id % 40 AS image, ts, event_type AS platform, user_id AS channel, CAST(floor(value * 10) AS BIGINT) AS reach FROM events)"


@query(f"""WITH {APPEAR}, g AS (SELECT image, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000 AS h, count(DISTINCT platform) AS platforms, CAST(sum(reach) AS BIGINT) AS reach, arg_min(platform, (ts, id)) AS first_platform, arg_min(channel, (ts, id)) AS first_channel FROM app GROUP BY 1)
  SELECT image, n, platforms, reach, first_platform, first_channel, CASE WHEN n < 2 THEN 0.0 ELSE round(n / greatest(1.0, h), 4) END AS velocity, round(least(100.0, n * 3 + platforms * 15 + least(30.0, reach / 1000)), 2) AS score FROM g""")
def viral_spread(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return I.viral_spread(
        e.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("image"), "ts", F.col("event_type").alias("platform"), F.col("user_id").alias("channel"), F.floor(F.col("value") * 10).alias("reach"))
    )


@query(f"""WITH t AS (SELECT o_custkey % 200 AS campaign, lpad(lower(to_hex(o_orderkey)), 16, '0') AS phash, o_orderdate AS first_seen FROM orders),
  l AS (SELECT *, lag(phash) OVER w AS before, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY campaign ORDER BY first_seen, phash)),
  s AS (SELECT campaign, phash, 'v' || CAST(n AS VARCHAR) AS version, CASE WHEN before IS NULL THEN 1.0 ELSE round(1 - bit_count(xor(CAST('0x' || before AS BIGINT), CAST('0x' || phash AS BIGINT))) / 64, 4) END AS similarity FROM l)
  SELECT *, CASE WHEN similarity >= 0.95 THEN 'minor' WHEN similarity >= 0.85 THEN 'moderate' WHEN similarity >= 0.7 THEN 'major' ELSE 'redesign' END AS change FROM s""")
def template_versions(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return I.template_versions(o.select((F.col("o_custkey") % 200).alias("campaign"), F.lpad(F.lower(F.hex("o_orderkey")), 16, "0").alias("phash"), F.col("o_orderdate").alias("first_seen")))


@query(f"""WITH {ENTITIES}, d AS (SELECT case_id % 50 AS campaign, channel, count(DISTINCT value) AS n FROM entities GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY n DESC, channel) AS k FROM d)
  SELECT campaign, channel AS mastermind, n AS degree FROM r WHERE k = 1""")
def mastermind(spark, sf_dir):
    """The best connected channel of each campaign (WN-13, GR-4)."""
    d = entities(spark, sf_dir).groupBy((F.col("case_id") % 50).alias("campaign"), "channel").agg(F.count_distinct("value").alias("degree"))
    top = d.groupBy("campaign").agg(F.max(F.struct("degree", (-F.col("channel")).alias("neg"))).alias("m"))
    return top.select("campaign", (-F.col("m.neg")).alias("mastermind"), F.col("m.degree").alias("degree"))


@query(f"""WITH {ENTITIES}, g AS (SELECT case_id % 50 AS campaign, count(DISTINCT channel) AS channels, count(DISTINCT value) FILTER (WHERE entity_type = 'PHONE') AS phones, count(DISTINCT value) FILTER (WHERE entity_type = 'UPI') AS upis, count(*) AS victims FROM entities GROUP BY 1),
  l AS (SELECT *, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[CAST(campaign % 4 AS INTEGER) + 1] AS level FROM g), s AS (SELECT *, round(least(100.0, CASE level WHEN 'CRITICAL' THEN 85 WHEN 'HIGH' THEN 65 WHEN 'MEDIUM' THEN 40 ELSE 20 END + least(20.0, channels * 2.0) + least(10.0, phones * 1.5)
    + least(10.0, upis * 2.0) + least(15.0, ln(1 + victims::DOUBLE))), 2) AS risk FROM l)
  SELECT campaign, channels, phones, upis, victims, level, risk, CASE WHEN risk >= 85 THEN 'EMERGENCY' WHEN risk >= 70 THEN 'CRITICAL' WHEN risk >= 50 THEN 'WARNING' ELSE 'WATCH' END AS alert FROM s""")
def graph_risk(spark, sf_dir):
    """Risk of campaigns from their graph (GR-6, AG-51, JN-11, PR-16e): distinct counts, no product of optional matches."""
    distinct = lambda k: F.count_distinct(F.when(F.col("entity_type") == k, F.col("value")))
    g = entities(spark, sf_dir).groupBy((F.col("case_id") % 50).alias("campaign")).agg(
        F.count_distinct("channel").alias("channels"), distinct("PHONE").alias("phones"), distinct("UPI").alias("upis"), F.count("*").alias("victims")
    )
    levels = F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])
    g = g.withColumn("level", F.get(levels, (F.col("campaign") % 4).cast("int")))
    g = g.withColumn("risk", S.graph_risk(F.col("level"), F.col("channels"), F.col("phones"), F.col("upis"), F.col("victims")))
    return g.withColumn("alert", S.expansion_alert(F.lit(0), F.col("risk")))


@query(f"""WITH {POSTS}, j AS (SELECT channel % 30 AS campaign, channel, message_id, ts AS created, views AS victims FROM posts), n AS (SELECT max(ts) AS now FROM posts),
  g AS (SELECT campaign, count(*) AS channels, count(*) FILTER (WHERE created >= now - INTERVAL 1 DAY) AS new_24h, CAST(sum(victims) AS BIGINT) AS victims FROM j, n GROUP BY 1), r AS (SELECT *, new_24h / greatest(channels - new_24h, 1) AS rate FROM g)
  SELECT campaign, channels, new_24h, round(rate * 100, 2) AS growth_pct, greatest(1, CAST(floor(victims / 7) AS BIGINT)) AS victims_per_day, round(channels * pow(1 + least(rate, 1.0), 30.0), 0) AS in_30_days, channels * 500 AS reach,
    CAST(CASE WHEN rate > 0.2 THEN 3 WHEN rate > 0.1 THEN 2 WHEN rate > 0.05 THEN 1 ELSE 0 END AS INTEGER) AS platforms_added FROM r""")
def growth_forecast(spark, sf_dir):
    p = channel_posts(spark, sf_dir)
    return I.growth_forecast(p.select((F.col("channel") % 30).alias("campaign"), "channel", F.col("ts").alias("created"), F.col("views").alias("victims")), p.agg(F.max("ts").alias("now")))


@query(f"""WITH {ENTITIES} SELECT CAST(channel AS VARCHAR) AS node, 'USES_' || entity_type AS type, count(*) AS links FROM entities WHERE value = 'phone-11' GROUP BY 1, 2""")
def ego_network(spark, sf_dir):
    e = entities(spark, sf_dir).select(F.col("channel").cast("string").alias("src"), F.col("value").alias("dst"), F.concat(F.lit("USES_"), F.col("entity_type")).alias("type"))
    return I.ego_network(e, "phone-11")


@query(f"""WITH {ENTITIES} SELECT CAST(channel AS VARCHAR) AS src, value AS dst, 'USES_' || entity_type AS type, count(*) AS count, min(seen_at) AS created_at, max(seen_at) AS last_seen FROM entities GROUP BY 1, 2, 3""")
def graph_edges(spark, sf_dir):
    """Edge upsert of the whole log (SC-29, GR-7)."""
    e = entities(spark, sf_dir).select(F.col("channel").cast("string").alias("src"), F.col("value").alias("dst"), F.concat(F.lit("USES_"), F.col("entity_type")).alias("type"), F.col("seen_at").alias("ts"))
    return I.merge_edges(e)


@query(f"""WITH {ENTITIES}, seen AS (SELECT entity_type AS label, value AS key, seen_at AS ts FROM entities UNION ALL SELECT 'CHANNEL', CAST(channel AS VARCHAR), seen_at FROM entities)
  SELECT label, key, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM seen GROUP BY 1, 2""")
def graph_nodes(spark, sf_dir):
    """Node upsert of the whole log (SC-28)."""
    e = entities(spark, sf_dir)
    seen = e.select(F.col("entity_type").alias("label"), F.col("value").alias("key"), F.col("seen_at").alias("ts")).unionByName(
        e.select(F.lit("CHANNEL").alias("label"), F.col("channel").cast("string").alias("key"), F.col("seen_at").alias("ts"))
    )
    return I.merge_nodes(seen)


def _in_merges(table, log, fold, rules, parts=3):
    """The table after the log has been merged part by part, as batches of a stream would."""
    for k in range(parts):
        table.merge(fold(log.where(F.pmod(F.xxhash64("ts", "part"), F.lit(parts)) == k)), rules)
    return table.read()


@query(f"""WITH {ENTITIES} SELECT CAST(channel AS VARCHAR) AS src, value AS dst, 'USES_' || entity_type AS type, count(*) AS count, min(seen_at) AS created_at, max(seen_at) AS last_seen FROM entities GROUP BY 1, 2, 3""")
def graph_edges_merged(spark, sf_dir):
    """Edges merged into a keyed table batch by batch (SC-29): only touched buckets are written."""
    e = entities(spark, sf_dir).select(F.col("channel").cast("string").alias("src"), F.col("value").alias("dst"), F.concat(F.lit("USES_"), F.col("entity_type")).alias("type"), F.col("seen_at").cast("timestamp").alias("ts"), F.col("case_id").alias("part"))
    table = keyed_table.edge_table(spark, new_path(spark, "edges"), buckets=16)
    merged = _in_merges(table, e, I.merge_edges, keyed_table.EDGE_RULES)
    kind = entities(spark, sf_dir).schema["seen_at"].dataType
    return merged.withColumns({c: F.col(c).cast(kind) for c in ("created_at", "last_seen")})


@query(f"""WITH {ENTITIES}, seen AS (SELECT entity_type AS label, value AS key, seen_at AS ts FROM entities UNION ALL SELECT 'CHANNEL', CAST(channel AS VARCHAR), seen_at FROM entities)
  SELECT label, key, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM seen GROUP BY 1, 2""")
def graph_nodes_merged(spark, sf_dir):
    """Nodes merged into a keyed table batch by batch (SC-28)."""
    e = entities(spark, sf_dir).withColumn("ts", F.col("seen_at").cast("timestamp"))
    seen = e.select(F.col("entity_type").alias("label"), F.col("value").alias("key"), "ts", F.col("case_id").alias("part")).unionByName(
        e.select(F.lit("CHANNEL").alias("label"), F.col("channel").cast("string").alias("key"), "ts", F.col("case_id").alias("part"))
    )
    table = keyed_table.node_table(spark, new_path(spark, "nodes"), buckets=16)
    merged = _in_merges(table, seen, I.merge_nodes, keyed_table.NODE_RULES)
    kind = e.schema["seen_at"].dataType
    return merged.withColumns({c: F.col(c).cast(kind) for c in ("first_seen", "last_seen")})


CAMP = f"""{POSTS}, c AS (SELECT channel % 30 AS campaign, count(DISTINCT channel) AS channels, CAST(sum(views) AS BIGINT) AS reach, count(DISTINCT media) AS platforms, count(*) FILTER (WHERE replies = 1) AS repeats FROM posts GROUP BY 1)"""


@query(f"""WITH {CAMP}, a AS (SELECT *, campaign * 5 AS growth_pct, campaign % 5 AS activity FROM c)
  SELECT campaign, 'RAPID_GROWTH' AS alert_type, 'CRITICAL' AS severity FROM a WHERE floor(channels * growth_pct / 100) >= 5 UNION ALL SELECT campaign, 'HIGH_VICTIM_RISK', 'CRITICAL' FROM a WHERE reach >= 10000
  UNION ALL SELECT campaign, 'CROSS_PLATFORM', 'EMERGENCY' FROM a WHERE platforms >= 3 UNION ALL SELECT campaign, 'ENTITY_REPEAT', 'HIGH' FROM a WHERE repeats >= 5
  UNION ALL SELECT campaign, 'EMERGING_HOTSPOT', 'WARNING' FROM a WHERE activity >= 3 UNION ALL SELECT campaign, 'NEW_CAMPAIGN', 'WATCH' FROM a WHERE channels <= 2""")
def early_warning(spark, sf_dir):
    p = channel_posts(spark, sf_dir).groupBy((F.col("channel") % 30).alias("campaign")).agg(
        F.count_distinct("channel").alias("channels"), F.sum("views").alias("reach"), F.count_distinct("media").alias("platforms"), F.count_if(F.col("replies") == 1).alias("repeats")
    )
    return I.alerts(p.withColumns({"growth_pct": F.col("campaign") * 5, "activity_ratio": F.col("campaign") % 5}))


PRED = "pred AS (SELECT doc_id, quality = 1 AS actual, ((doc_id * 7919 + quality * 300) % 1000) / 1000 AS score FROM labels)"


def _predictions(spark, sf_dir):
    k = (F.col("doc_id") * 7919 + F.col("quality") * 300) % 1000
    return read(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("actual"), (k / 1000).alias("score"))


RATES = """round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-8), 6) AS f1, round(fp / greatest(fp + tn, 1), 6) AS fpr"""
QUAD = "count(*) FILTER (WHERE actual AND {0}) AS tp, count(*) FILTER (WHERE NOT actual AND {0}) AS fp, count(*) FILTER (WHERE NOT actual AND NOT ({0})) AS tn, count(*) FILTER (WHERE actual AND NOT ({0})) AS fn"


@query(f"WITH {PRED}, q AS (SELECT {QUAD.format('score >= 0.5')} FROM pred) SELECT tp, fp, tn, fn, {RATES} FROM q")
def binary_metrics(spark, sf_dir):
    return E.binary_metrics(_predictions(spark, sf_dir))


@query(f"""WITH {PRED}, b AS (SELECT actual, CAST(floor(score * 100 + 1e-9) AS INTEGER) AS bin FROM pred), q AS (SELECT CAST(t AS INTEGER) AS t, {QUAD.format('bin >= t')} FROM b, generate_series(10, 99) g(t) GROUP BY 1)
  SELECT t, tp, fp, tn, fn, {RATES} FROM q""")
def threshold_sweep(spark, sf_dir):
    return E.threshold_sweep(_predictions(spark, sf_dir))


@query(f"""WITH {PRED}, r AS (SELECT actual, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM pred), s AS (SELECT sum(rk) FILTER (WHERE actual) AS r, count(*) FILTER (WHERE actual) AS p, count(*) FILTER (WHERE NOT actual) AS n FROM r)
  SELECT p AS positives, n AS negatives, round((r - p * (p + 1) / 2) / (p * n), 6) AS auc FROM s""")
def roc_auc(spark, sf_dir):
    return E.roc_auc(_predictions(spark, sf_dir))


CLASSES = "cls AS (SELECT lang AS actual, (['en', 'fr', 'de', 'es'])[CAST((doc_id * 7 + length(lang)) % 4 AS INTEGER) + 1] AS predicted FROM documents)"


def _classes(spark, sf_dir):
    langs = F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")])
    return read(spark, sf_dir, "documents").select(F.col("lang").alias("actual"), F.get(langs, ((F.col("doc_id") * 7 + F.length("lang")) % 4).cast("int")).alias("predicted"))


@query(f"""WITH {CLASSES}, n AS (SELECT actual, predicted, count(*) AS n FROM cls GROUP BY 1, 2)
  SELECT *, round(n / sum(n) OVER (PARTITION BY actual), 6) AS of_actual, round(n / sum(n) OVER (PARTITION BY predicted), 6) AS of_predicted FROM n""")
def confusion_matrix(spark, sf_dir):
    return E.confusion(_classes(spark, sf_dir))


@query(f"""WITH {CLASSES}, a AS (SELECT actual AS label, count(*) AS support, count(*) FILTER (WHERE actual = predicted) AS tp FROM cls GROUP BY 1), p AS (SELECT predicted AS label, count(*) AS pr FROM cls GROUP BY 1),
  j AS (SELECT label, coalesce(support, 0) AS support, coalesce(tp, 0) / greatest(coalesce(pr, 0), 1) AS p, coalesce(tp, 0) / greatest(coalesce(support, 0), 1) AS r FROM a FULL JOIN p USING (label))
  SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-8), 6) AS f1 FROM j""")
def per_class_f1(spark, sf_dir):
    return E.per_class(_classes(spark, sf_dir))


@query(f"""WITH {PRED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(CAST(actual AS INTEGER)), 6) AS accuracy, round(avg(score), 6) AS confidence FROM pred GROUP BY 1""")
def calibration_bins(spark, sf_dir):
    return E.calibration(_predictions(spark, sf_dir).select(F.col("score").alias("confidence"), F.col("actual").alias("correct")))


@query("""SELECT lang, source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM documents GROUP BY 1, 2""")
def corpus_stats(spark, sf_dir):
    """Counts and shares of a corpus (AG-7, AG-50); the total is a second small aggregate, not a window over all rows."""
    g = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return g.select("lang", "source", "n", F.round(100.0 * F.col("n") / g.agg(F.sum("n")).scalar(), 4).alias("pct"))


CHAIN = """log AS (SELECT conv_id AS chain, turn AS line, sha256(CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) || text) AS this_hash FROM conversations),
  chained AS (SELECT *, CASE WHEN line = 3 AND chain % 5 = 0 THEN 'tampered' ELSE lag(this_hash, 1, 'GENESIS') OVER (PARTITION BY chain ORDER BY line, this_hash) END AS prev_hash FROM log)"""


@query(f"""WITH {CHAIN}, v AS (SELECT *, prev_hash = lag(this_hash, 1, 'GENESIS') OVER (PARTITION BY chain ORDER BY line, this_hash) AS ok FROM chained)
  SELECT chain, count(*) AS lines, bool_and(ok) AS valid, min(line) FILTER (WHERE NOT ok) AS first_broken, substr(sha256(string_agg(this_hash, '' ORDER BY line, this_hash)), 1, 16) AS certificate FROM v GROUP BY 1""")
def hash_chain_verify(spark, sf_dir):
    """Tamper check of append-only logs with a certificate of each chain (WN-6, AG-28, DM-27)."""
    c = read(spark, sf_dir, "conversations")
    this = F.sha2(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"), F.col("text")).cast("binary"), 256)
    log = c.select(F.col("conv_id").alias("chain"), F.col("turn").alias("line"), this.alias("this_hash"))
    before = F.lag("this_hash", 1, "GENESIS").over(W.partitionBy("chain").orderBy("line", "this_hash"))
    kept = log.withColumn("prev_hash", F.when((F.col("line") == 3) & (F.col("chain") % 5 == 0), "tampered").otherwise(before))
    return verify_chains(kept)


def verify_chains(log):
    """(chain, lines, valid, first_broken, certificate) of a log with (chain, line, this_hash, prev_hash)."""
    w = W.partitionBy("chain").orderBy("line", "this_hash")
    checked = log.withColumn("ok", F.col("prev_hash") == F.lag("this_hash", 1, "GENESIS").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("line", "this_hash")))
    joined = F.array_join(F.transform(ordered, lambda x: x["this_hash"]), "")
    return checked.groupBy("chain").agg(
        F.count("*").alias("lines"), F.bool_and("ok").alias("valid"), F.min(F.when(~F.col("ok"), F.col("line"))).alias("first_broken"), T.stable_id(joined).alias("certificate")
    )


@query(f"""WITH {ENTITIES}, p AS (SELECT case_id % 40 AS campaign, count(DISTINCT value) AS entities, count(DISTINCT channel) AS nodes, count(*) FILTER (WHERE line_status = 'O') AS shots FROM entities GROUP BY 1)
  SELECT campaign, entities, nodes, shots, round(least(0.98, 0.3 + least(0.2, 0.02 * shots) + least(0.3, 0.03 * entities) + CASE WHEN nodes > 3 THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS confidence FROM p""")
def evidence_packages(spark, sf_dir):
    """Confidence of evidence packages (DM-22)."""
    g = entities(spark, sf_dir).groupBy((F.col("case_id") % 40).alias("campaign")).agg(
        F.count_distinct("value").alias("entities"), F.count_distinct("channel").alias("nodes"), F.count_if(F.col("line_status") == "O").alias("shots")
    )
    c = F.least(F.lit(0.98), 0.3 + F.least(F.lit(0.2), 0.02 * F.col("shots")) + F.least(F.lit(0.3), 0.03 * F.col("entities")) + F.when(F.col("nodes") > 3, 0.2).otherwise(0.0))
    return g.withColumn("confidence", F.round(c, 4))


