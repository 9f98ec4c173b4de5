"""Queries on cases, entities and complaints."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import scores as S
from vigilspark.functions import text as T
from vigilspark.operators import cases as C
from vigilspark.plans.testbed import CASES, ENTITIES, POSTS, cases, channel_posts, entities, read

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(f"""WITH {CASES} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'PENDING') AS pending,
  count(*) FILTER (WHERE status = 'APPROVED') AS approved, count(*) FILTER (WHERE status = 'REJECTED') AS rejected,
  count(*) FILTER (WHERE status = 'SUBMITTED') AS submitted, count(*) FILTER (WHERE status = 'ESCALATED') AS escalated FROM cases""")
def case_status_counts(spark, sf_dir):
    return C.status_counts(cases(spark, sf_dir))


@query(f"WITH {CASES} SELECT coalesce(category, 'Unknown') AS category, count(*) AS n FROM cases GROUP BY 1")
def case_by_category(spark, sf_dir):
    return C.count_by(cases(spark, sf_dir), "category", "category")


@query(f"WITH {CASES} SELECT coalesce(severity, 'Unknown') AS severity, count(*) AS n FROM cases GROUP BY 1")
def case_by_severity(spark, sf_dir):
    return C.count_by(cases(spark, sf_dir), "severity", "severity")


@query(f"""WITH {ENTITIES}, flags AS (SELECT entity_type, value, count(*) AS flags FROM entities GROUP BY 1, 2)
  (SELECT 'PHONE' AS entity_type, value, flags FROM flags WHERE entity_type = 'PHONE' ORDER BY flags DESC, value LIMIT 10)
  UNION ALL (SELECT 'URL' AS entity_type, value, flags FROM flags WHERE entity_type = 'URL' ORDER BY flags DESC, value LIMIT 10)""")
def top_flagged_entities(spark, sf_dir):
    e = entities(spark, sf_dir)
    tops = [C.top_entities(e, k).select(F.lit(k).alias("entity_type"), "value", "flags") for k in ("PHONE", "URL")]
    return tops[0].unionByName(tops[1])


@query(f"""WITH {CASES}, last AS (SELECT max(CAST(created_at AS DATE)) AS d FROM cases),
  spine AS (SELECT CAST(unnest(generate_series(d - INTERVAL 6 DAY, d, INTERVAL 1 DAY)) AS DATE) AS day FROM last),
  daily AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM cases GROUP BY 1)
  SELECT strftime(s.day, '%Y-%m-%d') AS day, strftime(s.day, '%a') AS weekday, coalesce(n, 0) AS n FROM spine s LEFT JOIN daily USING (day)""")
def daily_trend_zero_filled(spark, sf_dir):
    return C.daily_trend(cases(spark, sf_dir))


@query(f"""WITH {CASES}, dated AS (SELECT *, CAST(created_at AS DATE) AS day FROM cases), last AS (SELECT max(day) AS d FROM dated)
  SELECT strftime(day, '%Y-%m-%d') AS day, count(*) FILTER (WHERE category = 'investment_scam') AS investment_scam,
    count(*) FILTER (WHERE category = 'job_scam') AS job_scam, count(*) FILTER (WHERE category = 'loan_scam') AS loan_scam
  FROM dated, last WHERE day > d - INTERVAL 7 DAY GROUP BY 1""")
def trend_pivot(spark, sf_dir):
    return C.trend_by(cases(spark, sf_dir), "category", ["investment_scam", "job_scam", "loan_scam"])


@query(f"""WITH {POSTS} SELECT CAST(h.h AS INTEGER) AS hour, count(p.message_id) AS n FROM generate_series(0, 23) h(h)
  LEFT JOIN posts p ON hour(p.ts) = h.h GROUP BY 1""")
def hourly_distribution(spark, sf_dir):
    return C.hourly_distribution(channel_posts(spark, sf_dir), "ts")


@query(f"""WITH {CASES}, located AS (SELECT n_name AS district, r_name AS region, loss FROM cases JOIN customer ON c_custkey = officer_id
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
  g AS (SELECT district, region, count(*) AS cases, round(sum(loss), 2) AS loss FROM located GROUP BY 1, 2)
  SELECT *, cases > 1.05 * avg(cases) OVER () AS hotspot, round(cases / max(cases) OVER (), 4) AS scale FROM g""")
def district_heatmap(spark, sf_dir):
    """Cases and loss by district with a hotspot flag (AG-18, AG-53); mean and maximum are scalar subqueries over one row for each district."""
    located = (
        cases(spark, sf_dir)
        .join(read(spark, sf_dir, "customer"), F.col("officer_id") == F.col("c_custkey"))
        .join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    g = located.groupBy(F.col("n_name").alias("district"), F.col("r_name").alias("region")).agg(
        F.count("*").alias("cases"), F.round(F.sum("loss"), 2).alias("loss")
    )
    mean, most = g.agg(F.avg("cases")).scalar(), g.agg(F.max("cases")).scalar()
    return g.select("district", "region", "cases", "loss", (F.col("cases") > 1.05 * mean).alias("hotspot"), F.round(F.col("cases") / most, 4).alias("scale"))


@query(f"""WITH {ENTITIES}, g AS (SELECT entity_type, value, count(DISTINCT case_id) AS case_count, min(seen_at) AS first_seen, max(seen_at) AS last_seen
    FROM entities GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 3)
  SELECT entity_type, value, case_count, case_count >= 5 AS is_ring, CASE WHEN case_count >= 5 THEN 'CRITICAL' ELSE 'HIGH' END AS alert, first_seen, last_seen FROM g""")
def repeat_entities(spark, sf_dir):
    return C.repeat_entities(entities(spark, sf_dir))


@query(f"""WITH {CASES} SELECT case_id, status, severity, category, created_at FROM cases
  WHERE severity = 'HIGH' AND created_at >= TIMESTAMP '1996-01-01' ORDER BY created_at DESC, case_id LIMIT 20 OFFSET 40""")
def case_page(spark, sf_dir):
    found = C.filter_cases(cases(spark, sf_dir), severity="HIGH", date_from="1996-01-01")
    return C.page(found.select("case_id", "status", "severity", "category", "created_at"), [F.desc("created_at"), F.col("case_id")], 3, 20)


@query(f"""WITH {CASES} SELECT case_id, category, status, created_at FROM cases WHERE category ILIKE '%LOTTERY%' OR status ILIKE '%lottery%'
  ORDER BY created_at DESC, case_id LIMIT 50""")
def case_search(spark, sf_dir):
    found = C.search_columns(cases(spark, sf_dir), "LOTTERY", ["category", "status"]).select("case_id", "category", "status", "created_at")
    return C.page(found, [F.desc("created_at"), F.col("case_id")], 1, 50)


@query(f"""WITH {CASES}, {ENTITIES} SELECT case_id, status, category FROM cases WHERE case_id IN (SELECT case_id FROM entities WHERE value = 'upi-7')""")
def entity_history(spark, sf_dir):
    return C.entity_history(cases(spark, sf_dir), entities(spark, sf_dir), "upi-7").select("case_id", "status", "category")


@query(f"""WITH {CASES} SELECT case_id, coalesce(status, 'PENDING') AS status, coalesce(category, 'Unknown') AS category FROM cases WHERE case_id = 77""")
def case_point_lookup(spark, sf_dir):
    found = cases(spark, sf_dir).where("case_id = 77")
    return found.select("case_id", F.coalesce("status", F.lit("PENDING")).alias("status"), F.coalesce("category", F.lit("Unknown")).alias("category"))


@query(f"""WITH {CASES}, {ENTITIES}, held AS (SELECT case_id, list_sort(list(DISTINCT entity_type || ':' || value)) AS es FROM entities GROUP BY 1)
  SELECT c.case_id, CAST(coalesce(len(es), 0) AS INTEGER) AS n_entities, coalesce(array_to_string(es, ','), '') AS entities FROM cases c LEFT JOIN held h ON h.case_id = c.case_id""")
def case_with_entities(spark, sf_dir):
    joined = C.with_entities(cases(spark, sf_dir), entities(spark, sf_dir))
    return joined.select("case_id", F.size("entities").alias("n_entities"), F.array_join("entities", ",").alias("entities"))


@query(f"""WITH {CASES}, known AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment <> 'BUILDING')
  SELECT case_id, coalesce(c_name, 'Duty Officer') AS officer FROM cases LEFT JOIN known ON c_custkey = officer_id""")
def case_officer_left(spark, sf_dir):
    known = read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name")
    joined = cases(spark, sf_dir).join(known, F.col("officer_id") == F.col("c_custkey"), "left")
    return joined.select("case_id", F.coalesce("c_name", F.lit("Duty Officer")).alias("officer"))


@query(f"""WITH {CASES}, p AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, case_id) AS rn FROM cases WHERE status = 'PENDING')
  SELECT CAST(case_id AS VARCHAR) AS case_id, coalesce(category, '') AS category, coalesce(severity, '') AS severity, status,
    strftime(created_at, '%Y-%m-%d') AS created, printf('%.2f', loss) AS loss FROM p WHERE rn <= 10000""")
def csv_export_projection(spark, sf_dir):
    """Rows of the CSV export: strings, null as empty, two decimals, newest 10 000 (SC-12, where the cap is the feature)."""
    rows = C.page(C.filter_cases(cases(spark, sf_dir), status="PENDING"), [F.desc("created_at"), F.col("case_id")], 1, 10_000)
    return rows.select(
        F.col("case_id").cast("string").alias("case_id"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("severity", F.lit("")).alias("severity"),
        "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.format_string("%.2f", "loss").alias("loss"),
    )


@query(f"""WITH {ENTITIES} SELECT case_id, line, entity_type, value,
    CAST(row_number() OVER (PARTITION BY entity_type, value ORDER BY seen_at, case_id, line, amount) AS INTEGER) AS occurrence,
    count(*) OVER (PARTITION BY entity_type, value) AS flag_count FROM entities""")
def entity_flag_running(spark, sf_dir):
    return C.running_flags(entities(spark, sf_dir))


@query(f"""WITH {ENTITIES}, r AS (SELECT value AS request_id, line_status AS status, seen_at, case_id,
    row_number() OVER (PARTITION BY value ORDER BY seen_at DESC, case_id DESC, line DESC, amount DESC) AS n FROM entities WHERE entity_type = 'UPI')
  SELECT request_id, status, seen_at, case_id FROM r WHERE n = 1""")
def latest_record_wins(spark, sf_dir):
    log = entities(spark, sf_dir).where("entity_type = 'UPI'").withColumnRenamed("value", "request_id").withColumnRenamed("line_status", "status")
    last = C.latest_per_key(log, ["request_id"], [F.desc("seen_at"), F.desc("case_id"), F.desc("line"), F.desc("amount")])
    return last.select("request_id", "status", "seen_at", "case_id")


COMPLAINTS = """complaints AS (SELECT o_orderkey AS complaint_id, n_name AS district, o_totalprice AS loss,
    CASE WHEN o_custkey % 3 = 0 THEN '+91-' || CAST(6000000000 + o_custkey AS VARCHAR) END AS phone,
    CASE WHEN o_custkey % 3 = 1 THEN 'pay' || CAST(o_custkey AS VARCHAR) || '@ybl' END AS upi,
    CASE WHEN o_custkey % 2 = 0 THEN 't.me/g' || CAST(o_custkey % 50 AS VARCHAR) ELSE '' END AS telegram,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Investment Scam' ELSE 'Job Scam' END AS scam_type
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"""


def complaints(spark, sf_dir):
    o, key = read(spark, sf_dir, "orders"), F.col("o_custkey")
    located = o.join(read(spark, sf_dir, "customer"), key == F.col("c_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return located.select(
        F.col("o_orderkey").alias("complaint_id"), F.col("n_name").alias("district"), F.col("o_totalprice").alias("loss"),
        F.when(key % 3 == 0, F.concat(F.lit("+91-"), (key + 6_000_000_000).cast("string"))).alias("phone"),
        F.when(key % 3 == 1, F.concat(F.lit("pay"), key.cast("string"), F.lit("@ybl"))).alias("upi"),
        F.when(key % 2 == 0, F.concat(F.lit("t.me/g"), (key % 50).cast("string"))).otherwise("").alias("telegram"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Investment Scam").otherwise("Job Scam").alias("scam_type"),
    )


@query(f"""WITH {COMPLAINTS}, long AS (SELECT complaint_id, district, loss, 'PHONE' AS kind, phone AS value FROM complaints
    UNION ALL SELECT complaint_id, district, loss, 'UPI', upi FROM complaints UNION ALL SELECT complaint_id, district, loss, 'TELEGRAM', telegram FROM complaints)
  SELECT kind, value, count(DISTINCT complaint_id) AS complaints, round(sum(loss), 2) AS total_loss, count(DISTINCT district) AS districts
  FROM long WHERE value IS NOT NULL AND value <> '' GROUP BY 1, 2 HAVING count(DISTINCT complaint_id) >= 2""")
def victim_clusters(spark, sf_dir):
    return C.victim_clusters(complaints(spark, sf_dir))


@query(f"""WITH {COMPLAINTS} SELECT scam_type, count(*) AS complaints, round(sum(loss), 2) AS total_loss,
    count(*) FILTER (WHERE upi IS NOT NULL OR phone IS NOT NULL) AS linked FROM complaints GROUP BY 1""")
def complaint_stats(spark, sf_dir):
    linked = F.count_if(F.col("upi").isNotNull() | F.col("phone").isNotNull())
    return complaints(spark, sf_dir).groupBy("scam_type").agg(F.count("*").alias("complaints"), F.round(F.sum("loss"), 2).alias("total_loss"), linked.alias("linked"))


@query(f"""WITH {COMPLAINTS} SELECT complaint_id, scam_type, loss FROM complaints WHERE district = 'NATION_3' ORDER BY complaint_id DESC LIMIT 50""")
def complaints_of_district(spark, sf_dir):
    """Row-level security by district, then the newest rows (PR-7, PR-10, SO-8)."""
    return complaints(spark, sf_dir).where("district = 'NATION_3'").select("complaint_id", "scam_type", "loss").orderBy(F.desc("complaint_id")).limit(50)


@query(f"""WITH {COMPLAINTS} SELECT 'FIR-' || upper(substr(sha256(CAST(complaint_id AS VARCHAR)), 1, 8)) AS fir_no, complaint_id,
    CASE WHEN scam_type = 'Investment Scam' THEN 'IT Act §66D' ELSE 'IT Act §66' END AS section, loss,
    round(sum(loss) OVER (PARTITION BY district), 2) AS district_loss FROM complaints WHERE telegram = 't.me/g10'""")
def bulk_reports(spark, sf_dir):
    """A first information report for each victim of a campaign, with the loss of the district (AG-30, SF-45)."""
    from pyspark.sql import Window as W

    hit = complaints(spark, sf_dir).where("telegram = 't.me/g10'")
    number = F.concat(F.lit("FIR-"), F.upper(T.stable_id(F.col("complaint_id").cast("string"), 8)))
    section = F.when(F.col("scam_type") == "Investment Scam", "IT Act §66D").otherwise("IT Act §66")
    return hit.select(
        number.alias("fir_no"), "complaint_id", section.alias("section"), "loss", F.round(F.sum("loss").over(W.partitionBy("district")), 2).alias("district_loss")
    )


LEGAL_SQL = "legal(category, section, fir, authority, urgency) AS (VALUES " + ", ".join(
    f"('{k}', '{s}', {str(f).upper()}, '{a}', '{u}')" for k, (s, f, a, u) in X.LEGAL.items()
) + ")"


def legal_dim(spark):
    return spark.createDataFrame([(k, *v) for k, v in X.LEGAL.items()], "category string, section string, fir boolean, authority string, urgency string")


@query(f"""WITH {CASES}, {LEGAL_SQL} SELECT case_id, coalesce(section, 'IT Act §66') AS section, coalesce(fir, FALSE) AS fir,
    coalesce(authority, 'I4C') AS authority, coalesce(urgency, 'LOW') AS urgency FROM cases LEFT JOIN legal USING (category)""")
def case_legal_mapping(spark, sf_dir):
    """Legal response by category (PR-18, PR-20); the dimension has 14 rows and is broadcast."""
    joined = cases(spark, sf_dir).join(F.broadcast(legal_dim(spark)), "category", "left")
    return joined.select(
        "case_id", F.coalesce("section", F.lit("IT Act §66")).alias("section"), F.coalesce("fir", F.lit(False)).alias("fir"),
        F.coalesce("authority", F.lit("I4C")).alias("authority"), F.coalesce("urgency", F.lit("LOW")).alias("urgency"),
    )


@query(f"""WITH {CASES}, s AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 'CRITICAL' WHEN 'HIGH' THEN 'HIGH' ELSE 'LOW' END AS urgency,
    (case_id % 100) / 100.0 AS conf, (officer_id % 100) / 100.0 AS df FROM cases)
  SELECT case_id, CASE WHEN urgency = 'CRITICAL' OR df > 0.8 THEN 'CRITICAL' WHEN urgency = 'HIGH' OR conf > 0.85 OR df > 0.65 THEN 'HIGH'
    WHEN conf > 0.5 OR df > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM s""")
def case_severity_rule(spark, sf_dir):
    c = cases(spark, sf_dir)
    urgency = F.when(F.col("severity") == "CRITICAL", "CRITICAL").when(F.col("severity") == "HIGH", "HIGH").otherwise("LOW")
    return c.select("case_id", S.case_severity(urgency, (F.col("case_id") % 100) / 100.0, (F.col("officer_id") % 100) / 100.0).alias("severity"))


@query(f"""WITH {CASES}, r AS (SELECT case_id, CASE severity WHEN 'CRITICAL' THEN 'EMERGENCY' WHEN 'HIGH' THEN 'CRITICAL' WHEN 'MEDIUM' THEN 'WARNING' ELSE 'WATCH' END AS level FROM cases)
  SELECT level, CASE level WHEN 'EMERGENCY' THEN 'SMS,EMAIL' WHEN 'CRITICAL' THEN 'EMAIL' WHEN 'WARNING' THEN 'EMAIL' ELSE '' END AS channels, count(*) AS n FROM r GROUP BY 1, 2""")
def alert_routing(spark, sf_dir):
    """Which sinks an alert goes to by its severity (PR-17)."""
    s = F.col("severity")
    level = F.when(s == "CRITICAL", "EMERGENCY").when(s == "HIGH", "CRITICAL").when(s == "MEDIUM", "WARNING").otherwise("WATCH")
    routed = cases(spark, sf_dir).select(level.alias("level"))
    channels = F.when(F.col("level") == "EMERGENCY", F.array(F.lit("SMS"), F.lit("EMAIL"))).when(
        F.col("level").isin("CRITICAL", "WARNING"), F.array(F.lit("EMAIL"))
    ).otherwise(F.array().cast("array<string>"))
    return routed.groupBy("level", F.array_join(channels, ",").alias("channels")).agg(F.count("*").alias("n"))


@query(f"""WITH {CASES}, {ENTITIES}, held AS (SELECT case_id, list_sort(list(DISTINCT value) FILTER (WHERE entity_type = 'PHONE'))[1:5] AS p,
    list_sort(list(DISTINCT value) FILTER (WHERE entity_type = 'UPI'))[1:5] AS u, list_sort(list(DISTINCT value) FILTER (WHERE entity_type = 'URL'))[1:3] AS w FROM entities GROUP BY 1)
  SELECT 'CL-' || strftime(created_at, '%Y') || '-' || upper(substr(sha256(CAST(case_id AS VARCHAR)), 1, 6)) AS case_number,
    coalesce(category, 'other') AS crime_type, coalesce(array_to_string(p, ';'), '') AS phones, coalesce(array_to_string(u, ';'), '') AS upis,
    coalesce(array_to_string(w, ';'), '') AS urls FROM cases LEFT JOIN held USING (case_id) WHERE status = 'APPROVED'""")
def portal_submission(spark, sf_dir):
    """Approved cases in the shape of the national portal (PR-21, PR-23, SF-45)."""
    def first(kind, n):
        return F.slice(F.array_sort(F.collect_set(F.when(F.col("entity_type") == kind, F.col("value")))), 1, n)

    held = entities(spark, sf_dir).groupBy("case_id").agg(first("PHONE", 5).alias("p"), first("UPI", 5).alias("u"), first("URL", 3).alias("w"))
    done = cases(spark, sf_dir).where("status = 'APPROVED'").join(held, "case_id", "left")
    number = F.concat(F.lit("CL-"), F.date_format("created_at", "yyyy"), F.lit("-"), F.upper(T.stable_id(F.col("case_id").cast("string"), 6)))
    joined = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    return done.select(number.alias("case_number"), F.coalesce("category", F.lit("other")).alias("crime_type"), joined("p").alias("phones"), joined("u").alias("upis"), joined("w").alias("urls"))


@query(f"""WITH {ENTITIES} SELECT case_id, max_by(line_status, (seen_at, line, amount)) AS status, string_agg('[' || strftime(seen_at, '%Y-%m-%d') || '] ' || line_status, chr(10) ORDER BY seen_at, line, amount) AS notes
  FROM entities GROUP BY case_id""")
def status_transitions(spark, sf_dir):
    """Status and notes of each case reduced from its append-only event log (PR-22, SC-11)."""
    log = entities(spark, sf_dir).select(
        "case_id", F.struct("seen_at", "line", "amount").alias("at"), F.col("line_status").alias("s"),
        F.concat(F.lit("["), F.date_format("seen_at", "yyyy-MM-dd"), F.lit("] "), F.col("line_status")).alias("note"),
    )
    events = F.array_sort(F.collect_list(F.struct("at", "note")))
    return log.groupBy("case_id").agg(F.max_by("s", "at").alias("status"), F.array_join(F.transform(events, lambda e: e["note"]), "\n").alias("notes"))


@query(f"""WITH {CASES}, f AS (SELECT *, officer_id % 3 AS d, case_id % 4 AS o FROM cases WHERE status <> 'PENDING')
  SELECT count(*) AS reviewed, count(*) FILTER (WHERE d = 0) AS approved, round(count(*) FILTER (WHERE d = 0) / greatest(count(*), 1), 4) AS approval_rate,
    round(count(*) FILTER (WHERE o = 1) / greatest(count(*) FILTER (WHERE o IN (0, 1)), 1), 4) AS false_positive_rate,
    count(*) >= 200 AS phase2_ready, count(*) FILTER (WHERE o IN (0, 1)) >= 100 AS phase3_ready FROM f""")
def feedback_accuracy(spark, sf_dir):
    """Analyst feedback: approval rate, false positive rate, readiness (AG-8)."""
    d, o = F.col("officer_id") % 3, F.col("case_id") % 4
    n, approved, outcomes = F.count("*"), F.count_if(d == 0), F.count_if(o.isin(0, 1))
    return cases(spark, sf_dir).where("status <> 'PENDING'").agg(
        n.alias("reviewed"), approved.alias("approved"), F.round(S.ratio(approved, n), 4).alias("approval_rate"),
        F.round(S.ratio(F.count_if(o == 1), outcomes), 4).alias("false_positive_rate"), (n >= 200).alias("phase2_ready"), (outcomes >= 100).alias("phase3_ready"),
    )
