"""Queries on combined results: phone union, identities, freeze requests, alerts, top lists and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import text as T
from vigilspark.operators import intel as I
from vigilspark.operators import linking as L
from vigilspark.plans import link_plans as K
from vigilspark.plans.testbed import CASES, ENTITIES, cases, entities, read
from vigilspark.plans.text_plans import CLAIMS, FREEZE_SQL, HANDLES, claims

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


_STANDARD = f"list_transform(regexp_extract_all(t, '{X.PHONE}'), lambda x: right(regexp_replace(x, '[^0-9]', '', 'g'), 10))"
_DISGUISED = f"list_transform(regexp_extract_all(t, '{X.PHONE_DISGUISED}'), lambda x: right(regexp_replace(translate(upper(x), 'OIL', '011'), '[^0-9]', '', 'g'), 10))"


@query(f"""WITH p AS (SELECT c_custkey AS id, CAST(9000000000 + c_custkey * 7919 % 999999999 AS VARCHAR) AS a, CAST(6000000000 + c_custkey * 104729 % 999999999 AS VARCHAR) AS b FROM customer),
  x AS (SELECT id, 'call +91 ' || a || ' wa.me/91' || CASE WHEN id % 2 = 0 THEN a ELSE b END || ' or ' || replace(b, '0', 'O') || ' now' AS t FROM p),
  f AS (SELECT id, unnest({_STANDARD}) AS ten, 1 AS k FROM x UNION ALL SELECT id, unnest(regexp_extract_all(t, '{X.PHONE_WHATSAPP}', 1)), 2 FROM x UNION ALL SELECT id, unnest({_DISGUISED}), 3 FROM x)
  SELECT id, '+91-' || ten AS normalized, (['STANDARD', 'WHATSAPP_LINK', 'DISGUISED'])[min(k)] AS format_type, CASE WHEN min(k) = 3 THEN 0.7 ELSE 1.0 END::DOUBLE AS confidence
  FROM f WHERE regexp_matches(ten, '^[6-9][0-9]{{9}}$') GROUP BY id, ten""")
def phone_union(spark, sf_dir):
    """Numbers of all formats, the first format that finds one names it (SF-5)."""
    k = F.col("c_custkey")
    a, b = ((F.lit(n) + (k * m) % 999_999_999).cast("string") for n, m in ((9_000_000_000, 7919), (6_000_000_000, 104_729)))
    t = F.concat(F.lit("call +91 "), a, F.lit(" wa.me/91"), F.when(k % 2 == 0, a).otherwise(b), F.lit(" or "), F.replace(b, F.lit("0"), F.lit("O")), F.lit(" now"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), F.explode(T.phone_numbers(t)).alias("p")).select("id", "p.*")


@query()
def identity_resolution(spark, sf_dir):
    """Exact and fuzzy identities, clusters of equal value sets merged (DM-14, SE-7); an Arrow function scores, so rows only."""
    found = L.identity_clusters(K.identity_exact(spark, sf_dir), K.identity_fuzzy(spark, sf_dir))
    return found.select(F.array_join("members", ",").alias("members"), "source", "platforms", "probability")


_HANDLE = f"({'[' + ', '.join(repr(h) for h in HANDLES) + ']'})[CAST(o_custkey % {len(HANDLES)} AS INTEGER) + 1]"
REQUESTS = f"""opened AS (SELECT o_orderkey AS request_id, 'p' || CAST(o_custkey AS VARCHAR) || '@' || {_HANDLE} AS upi, o_orderdate AS ts, o_custkey AS officer FROM orders WHERE o_orderstatus <> 'P'),
  sent AS (SELECT l_orderkey AS request_id, l_linestatus = 'F' AS accepted, 'REF-' || CAST(l_partkey AS VARCHAR) AS reference, l_shipdate - INTERVAL 20 DAY AS ts FROM lineitem WHERE l_orderkey % 5 <> 0),
  judged AS (SELECT coalesce(s.request_id, o.request_id) AS request_id, s.ts, s.accepted, s.reference, s.ts >= o.ts AS valid FROM sent s LEFT JOIN opened o USING (request_id)),
  answers AS (SELECT request_id, max(struct_pack(ts := ts, accepted := accepted, reference := reference)) FILTER (WHERE valid) AS last, count(*) FILTER (WHERE NOT coalesce(valid, false)) AS refused FROM judged GROUP BY 1),
  requests AS (SELECT coalesce(o.request_id, a.request_id) AS request_id, upi, CASE WHEN o.request_id IS NULL THEN 'NOT_FOUND' WHEN last IS NULL THEN 'PENDING' WHEN last.accepted THEN 'SUBMITTED' ELSE 'REJECTED' END AS status,
    o.ts::TIMESTAMP AS created_at, CASE WHEN last.accepted THEN last.ts END::TIMESTAMP AS submitted_at, CASE WHEN last.accepted THEN last.reference ELSE '' END AS reference, coalesce(refused, 0) AS refused
    FROM opened o FULL JOIN answers a ON a.request_id = o.request_id)"""


def freeze_events(spark, sf_dir):
    """Orders as freeze requests, their line items as answers; some answers come too early, some have no request."""
    upi = F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("@"), F.get(F.array(*[F.lit(h) for h in HANDLES]), (F.col("o_custkey") % len(HANDLES)).cast("int")))
    opened = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("request_id"), upi.alias("upi"), F.lit("CREATE").alias("kind"), F.lit(None).cast("boolean").alias("accepted"),
        F.lit(None).cast("string").alias("reference"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
    )
    sent = read(spark, sf_dir, "lineitem").where("l_orderkey % 5 <> 0").select(
        F.col("l_orderkey").alias("request_id"), F.lit(None).cast("string").alias("upi"), F.lit("SUBMIT").alias("kind"), (F.col("l_linestatus") == "F").alias("accepted"),
        F.concat(F.lit("REF-"), F.col("l_partkey").cast("string")).alias("reference"), (F.col("l_shipdate").cast("timestamp_ntz") - F.expr("INTERVAL 20 DAY")).alias("ts"),
    )
    return opened.unionByName(sent)


@query(f"WITH {REQUESTS} SELECT * FROM requests")
def freeze_workflow(spark, sf_dir):
    """State of every freeze request (DM-28)."""
    return I.freeze_requests(freeze_events(spark, sf_dir))


@query(f"""WITH {REQUESTS}, h AS (SELECT *, lower(split_part(upi, '@', 2)) AS handle FROM requests WHERE status = 'SUBMITTED')
  SELECT request_id, '{{"requestType":"UPI_FREEZE","upiId":"' || upi || '","bankName":"' || CASE handle {FREEZE_SQL} ELSE 'Unknown (' || handle || ')' END || '","reference":"' || reference || '"}}' AS payload FROM h""")
def freeze_payloads(spark, sf_dir):
    """What is sent for a submitted request (RM-23)."""
    sent = I.freeze_requests(freeze_events(spark, sf_dir)).where("status = 'SUBMITTED'")
    fields = F.struct(F.lit("UPI_FREEZE").alias("requestType"), F.col("upi").alias("upiId"), T.freeze_bank(F.col("upi")).alias("bankName"), "reference")
    return sent.select("request_id", F.to_json(fields).alias("payload"))


@query(f"""WITH {CASES} SELECT case_id, substr('[' || severity || '] ' || category || chr(10) || substr('loss of ' || CAST(CAST(floor(loss) AS BIGINT) AS VARCHAR), 1, 80) || chr(10) || 'Action: ' || substr('freeze accounts and inform the district officer of the case within one day', 1, 60), 1, 160) AS sms
  FROM cases WHERE severity = 'CRITICAL'""")
def sms_alerts(spark, sf_dir):
    """Alert texts of critical cases (RM-27); without category no text."""
    c = cases(spark, sf_dir).where("severity = 'CRITICAL'")
    trigger = F.concat(F.lit("loss of "), F.floor("loss").cast("long").cast("string"))
    text = T.sms_text(F.col("severity"), F.col("category"), trigger, F.lit("freeze accounts and inform the district officer of the case within one day"))
    return c.select("case_id", text.alias("sms"))


@query("""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 3 > 0 THEN 'Phone numbers detected: ' || CAST(o_orderkey % 3 AS VARCHAR) END,
    CASE WHEN o_custkey % 2 > 0 THEN 'UPI IDs detected: ' || CAST(o_custkey % 2 AS VARCHAR) END, CASE WHEN o_custkey % 4 > 0 THEN 'Suspicious URLs detected: ' || CAST(o_custkey % 4 AS VARCHAR) END], lambda x: x IS NOT NULL), '; ') AS indicators FROM orders""")
def indicator_texts(spark, sf_dir):
    """Indicators of a classified text (RM-8)."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(o.alias("id"), F.array_join(T.indicators(o % 3, c % 2, c % 4), "; ").alias("indicators"))


TOP = f"""WITH {ENTITIES}, n AS (SELECT case_id % 97 AS campaign, entity_type, value, count(*) AS seen FROM entities GROUP BY ALL),
  s AS (SELECT campaign, count(*) AS n_entities, least(100, count(*) FILTER (WHERE seen > 1)) AS risk FROM n GROUP BY 1),
  top AS (SELECT * FROM s ORDER BY risk DESC, n_entities DESC, campaign LIMIT 10), r AS (SELECT n.*, row_number() OVER (PARTITION BY campaign ORDER BY seen DESC, value) AS k FROM n JOIN top USING (campaign))
  SELECT t.campaign, risk, n_entities, string_agg(value, ',' ORDER BY k) AS entities FROM top t JOIN r USING (campaign) WHERE k <= 10 GROUP BY ALL"""


@query(TOP)
def campaign_top(spark, sf_dir):
    """The ten campaigns of most risk, each with its ten most seen entities (SO-4)."""
    seen = entities(spark, sf_dir).groupBy((F.col("case_id") % 97).alias("campaign"), "entity_type", "value").agg(F.count("*").alias("seen"))
    scored = seen.groupBy("campaign").agg(F.count("*").alias("n_entities"), F.least(F.lit(100).cast("long"), F.count_if(F.col("seen") > 1)).alias("risk"))
    return I.top_with_items(scored, [F.desc("risk"), F.desc("n_entities"), F.asc("campaign")], 10, seen, "campaign", [F.desc("seen"), F.asc("value")], "value", 10).select(
        "campaign", "risk", "n_entities", F.array_join("items", ",").alias("entities")
    )


@query(f"""WITH {ENTITIES}, g AS (SELECT case_id % 997 AS campaign, count(DISTINCT channel) AS channels FROM entities GROUP BY 1),
  l AS (SELECT *, CASE WHEN channels >= 40 THEN 'HIGH' WHEN channels >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM g)
  SELECT campaign, channels, risk_level, CAST(row_number() OVER (ORDER BY risk_level DESC, channels DESC, campaign) AS INTEGER) AS position FROM l ORDER BY position LIMIT 50""")
def network_list(spark, sf_dir):
    """Campaigns by the name of their level, descending as text, then by channels; the first fifty (SO-7)."""
    g = entities(spark, sf_dir).groupBy((F.col("case_id") % 997).alias("campaign")).agg(F.count_distinct("channel").alias("channels"))
    level = F.when(F.col("channels") >= 40, "HIGH").when(F.col("channels") >= 10, "MEDIUM").otherwise("LOW")
    top = g.withColumn("risk_level", level).orderBy(F.desc("risk_level"), F.desc("channels"), "campaign").limit(50)
    from pyspark.sql import Window as W

    position = F.row_number().over(W.orderBy(F.desc("risk_level"), F.desc("channels"), "campaign"))  # over fifty rows
    return top.select("campaign", "channels", "risk_level", position.alias("position"))


@query(f"""WITH {CASES} SELECT officer_id, count(*) AS actions, count(*) FILTER (WHERE status = 'APPROVED') AS approved, strftime(max(created_at), '%Y-%m-%d') AS last_seen, c_name AS username, n_name AS district
  FROM cases JOIN customer ON c_custkey = officer_id JOIN nation ON n_nationkey = c_nationkey GROUP BY officer_id, c_name, n_name""")
def officer_directory(spark, sf_dir):
    """Officers with what the log tells of them (RM-30): counts by officer first, then joins of one row each."""
    done = cases(spark, sf_dir).groupBy("officer_id").agg(
        F.count("*").alias("actions"), F.count_if(F.col("status") == "APPROVED").alias("approved"), F.date_format(F.max("created_at"), "yyyy-MM-dd").alias("last_seen")
    )
    people = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("officer_id"), F.col("c_name").alias("username"), "c_nationkey")
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("district"))
    return done.join(people, "officer_id").join(F.broadcast(nations), "c_nationkey").drop("c_nationkey")


@query("""SELECT count(DISTINCT user_id) AS monitored_channels, count(*) FILTER (WHERE date_trunc('day', ts) = (SELECT date_trunc('day', max(ts)) FROM events)) AS posts_on_last_day,
  count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR) AS posts_in_last_hour, count(*) FILTER (WHERE event_type = 'error') AS alerts FROM events""")
def monitor_status(spark, sf_dir):
    """Snapshot of the monitor (RM-22)."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    now = e.select(F.max("ts").alias("now")).scalar()
    return e.withColumn("now", now).select(
        F.count_distinct("user_id").alias("monitored_channels"), F.count_if(F.to_date("ts") == F.to_date("now")).alias("posts_on_last_day"),
        F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 1 HOUR")).alias("posts_in_last_hour"), F.count_if(F.col("event_type") == "error").alias("alerts"),
    )


@query(f"WITH {CLAIMS} SELECT id, substr(text, 1, 200) AS raw_text, '' AS image_text, 'post-' || CAST(id AS VARCHAR) AS record_id FROM claims")
def feed_rows(spark, sf_dir):
    """Posts as feed rows with previews (RM-29)."""
    return I.feed_rows(claims(spark, sf_dir))
