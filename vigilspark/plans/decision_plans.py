"""Queries on collected posts and the decision score that follows from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import text as T
from vigilspark.operators import decision as D
from vigilspark.operators import intel as I
from vigilspark.plans.testbed import POSTS, channel_posts, read, sql_any
from vigilspark.plans.text_plans import _LIST, _WORDS, DOMAIN_SQL, _re, rule_hits_sql
from vigilspark.storage import materialize

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


PRESSING = " जल्दी करो अभी पैसा भेजो"
TOLD = f"""sites AS (SELECT page_id, CASE WHEN page_id % 23 = 5 THEN replace(url, '.example.', '.club.') ELSE url END AS url FROM pages),
  told AS (SELECT o_custkey // 10 AS channel, o_orderkey AS message_id, ({_LIST})[CAST(o_custkey % 15 AS INTEGER) + 1] || ' ' || ({_LIST})[CAST(o_orderkey % 7 AS INTEGER) + 1]
    || CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey // 10 % 4 > 0 THEN '{PRESSING}' WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN ' join https://t.me/chan' || (o_orderkey % 37) || '/5' WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 5 = 0 THEN ' or @chan' || (o_custkey % 61) ELSE '' END
    || CASE WHEN o_orderstatus = 'P' AND o_custkey // 10 % 3 > 0 THEN ' scan QR pay a' || o_custkey || '@YBL' WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 11 = 0 THEN ' call +91 98765 ' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 5, '0') ELSE '' END
    || coalesce(' see ' || url, '') AS text FROM orders LEFT JOIN sites ON o_custkey // 10 % 5 > 1 AND page_id = (o_orderkey * 7) % (SELECT 4 * count(*) FROM pages))"""


def told(spark, sf_dir):
    """(channel, message_id, text): orders told as posts with links to channels, payment addresses, phones and the addresses of pages."""
    pages = read(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 23 == 5, F.replace("url", F.lit(".example."), F.lit(".club."))).otherwise(F.col("url"))
    number = pages.agg((F.count("*") * 4).alias("n"))  # one row
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(number)).withColumn("page_id", F.col("o_orderkey") * 7 % F.col("n"))
    words, key, cust = F.array(*[F.lit(w) for w in _WORDS]), F.col("o_orderkey"), F.col("o_custkey")
    channel = F.floor(cust / 10)
    linking = F.when(channel % 5 > 1, F.col("page_id")).otherwise(-1 - key)  # no page; nulls would be one hot key
    o = o.withColumn("page_id", linking).join(pages.select("page_id", url.alias("url")), "page_id", "left")
    priority, status, none = F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit("")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    push = (
        F.when((priority == "1-URGENT") & (channel % 4 > 0), PRESSING).when((priority == "5-LOW") & (status == "O"), text(" join https://t.me/chan", key % 37, "/5"))
        .when((priority == "2-HIGH") & (key % 5 == 0), text(" or @chan", cust % 61)).otherwise(none)
    )
    contact = (
        F.when((status == "P") & (channel % 3 > 0), text(" scan QR pay a", cust, "@YBL"))
        .when((priority == "3-MEDIUM") & (key % 11 == 0), text(" call +91 98765 ", F.lpad((key % 10_000).cast("string"), 5, "0"))).otherwise(none)
    )
    said = F.concat(F.get(words, (cust % 15).cast("int")), F.lit(" "), F.get(words, (key % 7).cast("int")), push, contact, F.coalesce(F.concat(F.lit(" see "), "url"), none))
    return o.select(channel.alias("channel"), key.alias("message_id"), said.alias("text"))


COLLECTED = f"""{TOLD}, typed AS (SELECT channel, message_id, list_concat(
      list_concat(list_transform(regexp_extract_all(text, {_re(X.COLLECTED_PHONE)}), lambda x: {{'entity_type': 'PHONE', 'value': x}}), list_transform(regexp_extract_all(text, {_re(X.COLLECTED_UPI)}), lambda x: {{'entity_type': 'UPI', 'value': x}})),
      list_concat(list_transform(regexp_extract_all(text, {_re(X.COLLECTED_URL)}), lambda x: {{'entity_type': 'URL', 'value': x}}), list_transform(regexp_extract_all(text, {_re(X.COLLECTED_LINK)}), lambda x: {{'entity_type': 'TELEGRAM', 'value': x}}))) AS found FROM told),
  unnested AS (SELECT channel, unnest(found) AS e FROM typed),
  collected AS (SELECT DISTINCT channel, e.entity_type AS entity_type, e.value AS value FROM unnested UNION SELECT channel, 'QR', 'msg_' || message_id FROM told WHERE regexp_matches(text, {_re(X.QR_MENTION)}))"""


@query(f"WITH {COLLECTED} SELECT * FROM collected")
def collected_entities(spark, sf_dir):
    """Typed entities of the posts of channels as the collector reads them (SF-15, SC-17)."""
    return D.collected(told(spark, sf_dir))


SIGNALS = f"""{COLLECTED}, {POSTS}, names AS (SELECT s_suppkey AS channel, 'chan' || s_suppkey AS name, s_acctbal < 0 AS fraud FROM supplier),
  linked AS (SELECT DISTINCT channel, split_part(regexp_replace(value, '^@+|https?://t\\.me/', '', 'g'), '/', 1) AS linked FROM collected WHERE entity_type = 'TELEGRAM'),
  others AS (SELECT * FROM linked l WHERE linked <> '' AND NOT EXISTS (SELECT 1 FROM names n WHERE n.channel = l.channel AND n.name = l.linked)),
  urls AS (SELECT channel, value, row_number() OVER (PARTITION BY channel ORDER BY value) AS nth FROM collected WHERE entity_type = 'URL'),
  bad_urls AS (SELECT DISTINCT url AS value, page_id % 4 AS campaign FROM sites WHERE page_id % 25 = 3), hosts AS (SELECT DISTINCT {DOMAIN_SQL} AS domain FROM sites WHERE page_id % 40 = 0),
  uh AS (SELECT channel, count(*) AS url_hits FROM urls WHERE value IN (SELECT value FROM bad_urls) GROUP BY 1),
  camp AS (SELECT channel, count(DISTINCT campaign) AS campaigns FROM urls JOIN bad_urls USING (value) GROUP BY 1),
  lk AS (SELECT channel, count(*) AS linked, count(*) FILTER (WHERE linked IN (SELECT name FROM names WHERE fraud)) AS channel_hits FROM others GROUP BY 1),
  m AS (SELECT value, count(*) AS matches FROM (SELECT DISTINCT value FROM urls) JOIN hosts ON contains(value, domain) GROUP BY 1),
  dm AS (SELECT channel, count(*) AS domain_hits, sum(matches) AS domain_matches FROM urls JOIN m USING (value) GROUP BY 1),
  kd AS (SELECT channel, count(*) FILTER (WHERE entity_type = 'UPI') AS upis, count(*) FILTER (WHERE entity_type = 'PHONE') AS phones, count(*) FILTER (WHERE entity_type = 'QR') > 0 AS has_qr FROM collected GROUP BY 1),
  tl AS (SELECT channel, bool_or({sql_any('value', X.DECISION_TLDS)}) AS bad_tld FROM urls WHERE nth <= 10 GROUP BY 1),
  cn AS (SELECT channel, count(*) AS connections FROM collected WHERE entity_type <> 'QR' AND (entity_type, value) IN (SELECT (entity_type, value) FROM collected GROUP BY entity_type, value HAVING count(*) >= 2) GROUP BY 1),
  pc AS (SELECT channel, round(count(*) FILTER (WHERE forwards > 0) / count(*), 3) AS forward_ratio, round(count(*) FILTER (WHERE media = 'images') / count(*) * 100, 2) AS image_pct,
    CASE WHEN count(nullif(message_id, 0)) >= 2 THEN 1 - count(nullif(message_id, 0)) / (max(nullif(message_id, 0)) - min(nullif(message_id, 0)) + 1) ELSE 0 END AS deletion_rate FROM posts GROUP BY 1),
  ft AS (SELECT channel, text, row_number() OVER (PARTITION BY channel ORDER BY message_id, text) AS nth FROM told),
  pr AS (SELECT channel, count(*) FILTER (WHERE {sql_any('text', X.URGENCY_DECISION)}) / count(*) * 100 AS urgency_pct, count(*) FILTER (WHERE {sql_any('text', X.BACKUP_DECISION)}) AS backup FROM ft WHERE nth <= 100 GROUP BY 1),
  sp AS (SELECT channel, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM told WHERE trim(text) <> ''),
  hi AS (SELECT channel, round(count(*) FILTER (WHERE d / nullif(d + l, 0) > 0.2 AND d / nullif(d + l, 0) <= 0.6) / count(*), 3) AS hinglish FROM sp GROUP BY 1),
  sn AS (SELECT o_custkey // 10 AS channel, arg_max(floor(o_totalprice / 10), struct_pack(a := o_orderdate, b := floor(o_totalprice / 10))) AS subscribers FROM orders GROUP BY 1),
  hw AS (SELECT channel, (isodow(ts) - 1) * 24 + hour(ts) AS h, count(*) AS n FROM posts WHERE ts IS NOT NULL GROUP BY 1, 2), pf AS (SELECT h, sum(n) AS m FROM hw WHERE channel IN (SELECT channel FROM names WHERE fraud) GROUP BY 1),
  sm AS (SELECT channel, round(sum(n * coalesce(m, 0)) / (sqrt(sum(n * n)) * (SELECT sqrt(sum(m * m)) FROM pf)), 6) AS similarity FROM hw LEFT JOIN pf USING (h) GROUP BY 1),
  lb AS (SELECT channel, {"greatest(" + ", ".join(rule_hits_sql(p) for _, p in X.RULE_PATTERNS) + ")"} AS hits FROM told),
  cl AS (SELECT channel, avg(CAST(hits >= 2 AS INTEGER)) AS confidence FROM lb GROUP BY 1),
  every AS (SELECT channel FROM told UNION SELECT channel FROM posts UNION SELECT channel FROM names),
  sig AS (SELECT channel, coalesce(url_hits, 0) + coalesce(channel_hits, 0) AS xref_hits, coalesce(domain_hits, 0) AS domain_hits, coalesce(upis, 0) AS upis, coalesce(phones, 0) AS phones, coalesce(linked, 0) AS linked,
    coalesce(connections, 0) AS connections, coalesce(campaigns, 0) AS campaigns, CAST(coalesce(url_hits, 0) + coalesce(channel_hits, 0) + coalesce(domain_matches, 0) AS BIGINT) AS overlap, coalesce(backup, 0) AS backup,
    coalesce(forward_ratio, 0.0) AS forward_ratio, coalesce(similarity, 0.0) AS similarity, coalesce(subscribers, 0.0) AS subscribers, coalesce(urgency_pct, 0.0) AS urgency_pct, coalesce(deletion_rate, 0.0) AS deletion_rate,
    coalesce(confidence, 0.0) AS confidence, coalesce(image_pct, 0.0) AS image_pct, coalesce(hinglish, 0.0) AS hinglish, coalesce(bad_tld, false) AS bad_tld, coalesce(has_qr, false) AS has_qr
    FROM every LEFT JOIN uh USING (channel) LEFT JOIN camp USING (channel) LEFT JOIN lk USING (channel) LEFT JOIN dm USING (channel) LEFT JOIN kd USING (channel) LEFT JOIN tl USING (channel) LEFT JOIN cn USING (channel)
    LEFT JOIN pc USING (channel) LEFT JOIN pr USING (channel) LEFT JOIN hi USING (channel) LEFT JOIN sn USING (channel) LEFT JOIN sm USING (channel) LEFT JOIN cl USING (channel))"""


@query(f"WITH {SIGNALS} SELECT * FROM sig")
def decision_signals(spark, sf_dir):
    """The twenty inputs of the decision score of every channel that posts, tells something or has a name (DM-11a to d)."""
    posts, texts = channel_posts(spark, sf_dir), told(spark, sf_dir)
    s = read(spark, sf_dir, "supplier")
    names = s.select(F.col("s_suppkey").alias("channel"), F.concat(F.lit("chan"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_acctbal") < 0).alias("fraud"))
    site = F.when(F.col("page_id") % 23 == 5, F.replace("url", F.lit(".example."), F.lit(".club."))).otherwise(F.col("url"))
    sites = read(spark, sf_dir, "pages").select("page_id", site.alias("url"))
    bad = sites.where("page_id % 25 = 3").select(F.lit("URL").alias("entity_type"), F.col("url").alias("value"), (F.col("page_id") % 4).alias("campaign"))
    blocked = bad.select("entity_type", "value").unionByName(names.where("fraud").select(F.lit("CHANNEL").alias("entity_type"), F.col("name").alias("value")))
    domains = sites.where("page_id % 40 = 0").select(T.url_domain(F.col("url")).alias("domain"))
    size = F.floor(F.col("o_totalprice") / 10)
    snapshots = read(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 10).alias("channel"), F.col("o_orderdate").alias("date"), size.alias("subscribers"))
    entities = materialize(D.collected(texts), "collected")  # campaigns read it too
    campaigns = entities.where("entity_type = 'URL'").select("channel", "value").join(bad.select("value", "campaign").distinct(), "value")
    return D.decision_signals(
        posts, texts, names, blocked, domains, snapshots, D.schedule_similarity(posts, names.where("fraud")), D.rule_confidence(texts), campaigns, entities=entities
    )


SCORED = f"""{SIGNALS}, x AS (SELECT *, least(40.0, xref_hits * 20.0) AS xr FROM sig), p AS (SELECT channel,
    least(100.0, xr + least(domain_hits, greatest(1.0, ceil((65 - xr) / 25))) * 25 + CASE WHEN upis > 0 THEN least(15.0, upis * 5.0) ELSE 0 END + CASE WHEN phones > 2 THEN least(10.0, phones * 3.0) ELSE 0 END + CASE WHEN bad_tld THEN 10 ELSE 0 END)::DOUBLE AS infrastructure,
    least(100.0, CASE WHEN linked > 5 THEN least(30.0, linked * 3.0) ELSE 0 END + CASE WHEN forward_ratio > 0.3 THEN 20 ELSE 0 END + CASE WHEN connections > 10 THEN least(25.0, connections * 2.0) ELSE 0 END + CASE WHEN campaigns > 0 THEN least(15.0, campaigns * 5.0) ELSE 0 END + CASE WHEN overlap > 0 THEN least(20.0, overlap * 10.0) ELSE 0 END)::DOUBLE AS network,
    least(100.0, CASE WHEN similarity > 0.8 THEN 40 WHEN similarity > 0.6 THEN 20 ELSE 0 END + CASE WHEN subscribers > 10000 THEN 10 ELSE 0 END + CASE WHEN urgency_pct > 30 THEN 25 WHEN urgency_pct > 10 THEN 10 ELSE 0 END + CASE WHEN backup > 0 THEN 15 ELSE 0 END + CASE WHEN deletion_rate > 0.3 THEN 10 ELSE 0 END)::DOUBLE AS behavioral,
    least(100.0, CASE WHEN confidence > 0.8 THEN 50 WHEN confidence > 0.5 THEN 25 ELSE 0 END + CASE WHEN has_qr AND upis > 0 THEN 20 ELSE 0 END + CASE WHEN image_pct > 50 AND upis > 0 THEN 15 ELSE 0 END + CASE WHEN hinglish > 0.3 THEN 10 ELSE 0 END)::DOUBLE AS content FROM x),
  t AS (SELECT *, round((0.3::DOUBLE * infrastructure + 0.25::DOUBLE * network + 0.25::DOUBLE * behavioral + 0.2::DOUBLE * content), 2) AS score FROM p)"""


@query(f"""WITH {SCORED} SELECT *, CASE WHEN score >= 85 THEN 'BLOCK' WHEN score >= 70 THEN 'ESCALATE' WHEN score >= 50 THEN 'INVESTIGATE' WHEN score >= 30 THEN 'MONITOR' ELSE 'IGNORE' END AS decision FROM t""")
def decision_score(spark, sf_dir):
    """Decisions from the derived inputs (DM-11)."""
    return I.decision_score(decision_signals(spark, sf_dir))
