"""Further queries: ordering, alert state, legal and image rules, evaluation of decisions, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import scores as S
from vigilspark.functions import text as T
from vigilspark.operators.scan import split_in_order
from vigilspark.plans import decision_plans as D
from vigilspark.plans import intel_plans as P
from vigilspark.plans.case_plans import LEGAL_SQL, legal_dim
from vigilspark.plans.intel_plans import CAMP, RECOMMENDED
from vigilspark.plans.testbed import POSTS, channel_posts, read, sql_any
from vigilspark.plans.text_plans import CLAIMS, claims

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


_EMPTY = "''"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(P._whole(f"""WITH {RECOMMENDED} SELECT channel, final_action, urgency FROM rec
  ORDER BY suppression <> '', CASE urgency WHEN 'IMMEDIATE' THEN 0 WHEN '24_HOURS' THEN 1 WHEN 'ROUTINE' THEN 2 ELSE 3 END, channel LIMIT 20"""))
def recommendation_queue(spark, sf_dir):
    """The analyst's queue: not suppressed first, then by urgency (SO-5, SO-9)."""
    rank = F.when(F.col("urgency") == "IMMEDIATE", 0).when(F.col("urgency") == "24_HOURS", 1).when(F.col("urgency") == "ROUTINE", 2).otherwise(3)
    return P._recommended(spark, sf_dir, whole=True).select("channel", "final_action", "urgency", "suppression").orderBy(F.col("suppression") != "", rank, "channel").limit(20).drop("suppression")


@query(f"""WITH {CAMP}, a AS (SELECT campaign, 'HIGH_VICTIM_RISK' AS alert_type FROM c WHERE reach >= 10000 UNION ALL SELECT campaign, 'CROSS_PLATFORM' FROM c WHERE platforms >= 3 UNION ALL SELECT campaign, 'RAPID_GROWTH' FROM c WHERE floor(channels * campaign * 5 / 100) >= 5)
  SELECT campaign, alert_type FROM a WHERE campaign % 4 <> 0""")
def open_critical_alerts(spark, sf_dir):
    """Critical and emergency alerts that nobody has acknowledged (PR-9, ST-8)."""
    every = P.early_warning(spark, sf_dir).where(F.col("severity").isin("CRITICAL", "EMERGENCY"))
    acks = spark.range(0, 30, 4).select(F.col("id").alias("campaign"))
    return every.join(acks, "campaign", "left_anti").select("campaign", "alert_type")


def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, c in pairs) + f" ELSE '{default}' END"


_CELEB, _INV = sql_any("text", X.CELEBRITY_WORDS), sql_any("text", X.USE_INVESTMENT)
USE = _case(
    [("SEXTORTION", sql_any("text", X.USE_SEXTORTION)), ("DIGITAL_ARREST", sql_any("text", X.USE_ARREST)), ("FAKE_ENDORSEMENT", f"{_CELEB} AND {_INV}"), ("INVESTMENT_SCAM", _INV),
     ("FAKE_ENDORSEMENT", _CELEB), ("DIGITAL_ARREST", sql_any("text", X.OFFICIAL_WORDS))], "OTHER",
)


@query(f"WITH {CLAIMS} SELECT id, {USE} AS use_case FROM claims")
def use_case_inference(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.use_case(F.col("text")).alias("use_case"))


@query(f"""WITH {CLAIMS}, {LEGAL_SQL}, l AS (SELECT id, author, {_case([(X.CATEGORIES[k][0], "regexp_matches(lower(text), '" + chr(92) + "b(?:" + '|'.join(x.replace('-', chr(92) + '-') for x in w) + ")" + chr(92) + "b')") for k, w in X.HEURISTIC_KEYWORDS], "unknown")} AS category FROM claims),
  j AS (SELECT id, category, coalesce(section, 'IT Act §66') AS section, coalesce(urgency, 'LOW') AS base, (author % 100) / 100.0 AS df FROM l LEFT JOIN legal USING (category))
  SELECT id, category, section, CASE WHEN df > 0.8 THEN CASE base WHEN 'LOW' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'HIGH' ELSE 'CRITICAL' END ELSE base END AS urgency,
    CASE WHEN base = 'CRITICAL' OR df > 0.8 THEN 'CRITICAL' WHEN base = 'HIGH' OR df > 0.65 THEN 'HIGH' WHEN category <> 'unknown' OR df > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM j""")
def text_to_case(spark, sf_dir):
    """From a text to a case: class, legal section, escalated urgency, severity (DM-25, PR-19, PR-16d)."""
    ids = F.create_map(*[F.lit(x) for k, c in enumerate(X.CATEGORIES) for x in (k, c[0])])
    labelled = claims(spark, sf_dir).select("id", F.coalesce(ids[T.heuristic_label(F.col("text"))], F.lit("unknown")).alias("category"), ((F.col("author") % 100) / 100.0).alias("df"))
    j = labelled.join(F.broadcast(legal_dim(spark)), "category", "left").withColumn("base", F.coalesce("urgency", F.lit("LOW")))
    raised = F.when(F.col("base") == "LOW", "MEDIUM").when(F.col("base") == "MEDIUM", "HIGH").otherwise("CRITICAL")
    confidence = F.when(F.col("category") == "unknown", 0.0).otherwise(0.85)
    return j.select(
        "id", "category", F.coalesce("section", F.lit("IT Act §66")).alias("section"), F.when(F.col("df") > 0.8, raised).otherwise(F.col("base")).alias("urgency"),
        S.case_severity(F.col("base"), confidence, F.col("df")).alias("severity"),
    )


@query(f"WITH {CLAIMS} SELECT id, trim(coalesce({', '.join(f'nullif(regexp_extract(text, {_re(p)}), {_EMPTY})' for p in X.CLAIMS)}, '')) AS claim FROM claims")
def investment_claims(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.investment_claim(F.col("text")).alias("claim"))


@query(f"""WITH d AS (SELECT page_id, lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]+)', 1)) AS domain, page_id * 7 % 200 AS age, page_id % 3 = 0 AS privacy, (['IN', 'US', NULL])[CAST(page_id % 3 AS INTEGER) + 1] AS country FROM pages)
  SELECT page_id, domain, CAST(least(100, CASE WHEN age < 30 THEN 30 ELSE 0 END + CASE WHEN age < 90 THEN 15 ELSE 0 END + CASE WHEN privacy THEN 10 ELSE 0 END + CASE WHEN country IS NOT NULL AND country NOT IN ('IN', 'India') THEN 15 ELSE 0 END
    + CASE WHEN {sql_any('domain', X.DOMAIN_WORDS)} THEN 20 ELSE 0 END) AS INTEGER) AS risk FROM d""")
def domain_risk(spark, sf_dir):
    """Domain risk from registration columns (SF-37)."""
    k = F.col("page_id")
    d = read(spark, sf_dir, "pages").select(
        "page_id", T.url_domain(F.col("url")).alias("domain"), (k * 7 % 200).alias("age"), (k % 3 == 0).alias("privacy"), F.get(F.array(F.lit("IN"), F.lit("US"), F.lit(None)), (k % 3).cast("int")).alias("country")
    )
    return d.select("page_id", "domain", T.domain_risk(F.col("domain"), F.col("age"), F.col("privacy"), F.col("country")).alias("risk"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_quantity / 20 > 1.5 AND l_partkey % 50 < 25 AND l_suppkey % 60 < 30 THEN 'SCREENSHOT' WHEN l_partkey % 200 < 80 AND l_quantity / 20 > 1.2 THEN 'WHATSAPP_FORWARD'
    WHEN l_suppkey % 120 > 80 AND l_partkey % 256 > 100 THEN 'DESIGNED_GRAPHIC' WHEN l_discount * 8 > 0.6 AND l_tax > 0.02 AND l_partkey % 130 < 80 THEN 'HANDWRITTEN' ELSE 'PHOTO' END AS image_type FROM lineitem""")
def image_types(spark, sf_dir):
    """Image kinds from pixel statistics, here columns of line items (SF-54)."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kind = T.image_type(F.col("l_quantity") / 20, p % 50, s % 60, p % 200, s % 120, p % 256, F.col("l_discount") * 8, F.col("l_tax"), p % 130)
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), kind.alias("image_type"))


@query("""WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN k <= n * 80 // 100 THEN 'train' WHEN k <= n * 80 // 100 + n * 10 // 100 THEN 'validation' ELSE 'test' END AS split FROM h""")
def dataset_split(spark, sf_dir):
    """Exact 80/10/10 split in a seeded order (WN-14): global ranks by pieces, not by one task."""
    shuffled = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary"), 256).alias("o"))
    return split_in_order(shuffled, ["o", "doc_id"], [("train", 80), ("validation", 10), ("test", 10)]).select("doc_id", "split")


@query("""WITH t AS (SELECT o_custkey % 200 AS campaign, lpad(lower(to_hex(o_orderkey)), 16, '0') AS phash, o_orderdate AS first_seen FROM orders),
  l AS (SELECT *, lag(phash) OVER w AS before, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY campaign ORDER BY first_seen, phash)),
  s AS (SELECT campaign, n, CASE WHEN before IS NULL THEN 1.0 ELSE round(1 - bit_count(xor(CAST('0x' || before AS BIGINT), CAST('0x' || phash AS BIGINT))) / 64, 4) END AS sim FROM l)
  SELECT campaign, string_agg('v' || CAST(n AS VARCHAR) || ': ' || CASE WHEN sim >= 0.95 THEN 'minor' WHEN sim >= 0.85 THEN 'moderate' WHEN sim >= 0.7 THEN 'major' ELSE 'redesign' END, ' -> ' ORDER BY n) AS evolution FROM s GROUP BY 1""")
def template_evolution(spark, sf_dir):
    """Evolution of templates in one line for each campaign (WN-3)."""
    v = P.template_versions(spark, sf_dir).select("campaign", F.substring("version", 2, 9).cast("int").alias("n"), F.concat("version", F.lit(": "), "change").alias("step"))
    steps = F.array_sort(F.collect_list(F.struct("n", "step")))
    return v.groupBy("campaign").agg(F.array_join(F.transform(steps, lambda s: s["step"]), " -> ").alias("evolution"))


@query(f"""WITH {CLAIMS}, c AS (SELECT id, {_case([(n, f"regexp_matches(lower(text), {_re(p)})") for n, p in X.CAMPAIGN_CATEGORIES], "Other")} AS category FROM claims),
  books(o, name, steps) AS (VALUES {", ".join(f"({k}, '{n}', {s})" for k, (n, s) in enumerate(X.PLAYBOOKS))}),
  m AS (SELECT id, category, name, steps, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM c LEFT JOIN books ON contains(lower(category), lower(name)) OR contains(lower(name), lower(category)))
  SELECT id, category, coalesce(name, 'Unknown') AS playbook, CAST(coalesce(steps, 1) AS INTEGER) AS steps FROM m WHERE r = 1""")
def playbook_match(spark, sf_dir):
    """Playbook of each claim, names contained either way, the first wins (DM-23); five fixed playbooks, so a chain of conditions."""
    low = F.lower("text")
    c = claims(spark, sf_dir).select("id", T.first_match([(n, low.rlike(p)) for n, p in X.CAMPAIGN_CATEGORIES], "Other").alias("category"))
    lc = F.lower("category")
    hit = [(n, lc.contains(n.lower()) | F.lit(n.lower()).contains(lc)) for n, _ in X.PLAYBOOKS]
    steps = F.create_map(*[F.lit(x) for p in X.PLAYBOOKS for x in p])
    named = c.withColumn("playbook", T.first_match(hit, "Unknown"))
    return named.withColumn("steps", F.coalesce(steps[F.col("playbook")], F.lit(1)))


@query(f"""WITH d AS ({D.ORACLE['decision_score']}), t AS (SELECT decision AS predicted, CASE channel % 3 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'IGNORE' ELSE 'MONITOR' END AS actual FROM d)
  SELECT actual, predicted, count(*) AS n, count(*) FILTER (WHERE actual = 'IGNORE' AND predicted IN ('BLOCK', 'ESCALATE')) AS critical FROM t GROUP BY 1, 2""")
def decision_evaluation(spark, sf_dir):
    """Decisions against ground truth with critical errors (DM-29, AG-43, AG-49)."""
    truth = F.when(F.col("channel") % 3 == 0, "BLOCK").when(F.col("channel") % 3 == 1, "IGNORE").otherwise("MONITOR")
    d = D.decision_score(spark, sf_dir).select(truth.alias("actual"), F.col("decision").alias("predicted"))
    bad = (F.col("actual") == "IGNORE") & F.col("predicted").isin("BLOCK", "ESCALATE")
    return d.groupBy("actual", "predicted").agg(F.count("*").alias("n"), F.count_if(bad).alias("critical"))


@query(f"""WITH {P.PRED}, b AS (SELECT actual, CAST(floor(score * 100 + 1e-9) AS INTEGER) AS bin FROM pred), q AS (SELECT CAST(t AS INTEGER) AS t, {P.QUAD.format('bin >= t')} FROM b, generate_series(30, 94) g(t) GROUP BY 1),
  s AS (SELECT t, round(tp / greatest(tp + fn, 1) - 2 * (fp / greatest(fp + tn, 1)), 6) AS score FROM q) SELECT t, score FROM s ORDER BY score DESC, t LIMIT 1""")
def best_threshold(spark, sf_dir):
    """The threshold with the largest recall less twice the false positive rate (AG-45)."""
    from vigilspark.operators import evaluation as E

    sweep = E.threshold_sweep(P._predictions(spark, sf_dir), 30, 94)
    score = F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)) - 2 * (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))), 6)
    return sweep.select("t", score.alias("score")).orderBy(F.desc("score"), "t").limit(1)


@query(f"""WITH {POSTS} SELECT channel, round(least(avg(views) FILTER (WHERE views > 0) / (50 + channel), 5.0), 4) AS view_ratio FROM posts GROUP BY 1""")
def view_subscriber_ratio(spark, sf_dir):
    """Mean positive views over subscribers, at most 5 (AG-37)."""
    seen = F.avg(F.when(F.col("views") > 0, F.col("views")))
    return channel_posts(spark, sf_dir).groupBy("channel").agg(seen.alias("v")).select("channel", F.round(F.least(F.col("v") / (F.col("channel") + 50), F.lit(5.0)), 4).alias("view_ratio"))


@query("""WITH e AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'UPI' WHEN 2 THEN 'URL' ELSE 'OTHER' END AS kind FROM customer)
  SELECT id, kind, CASE kind WHEN 'PHONE' THEN 'Airtel' WHEN 'UPI' THEN 'PhonePe' WHEN 'URL' THEN 'SUSPICIOUS_TLD' ELSE 'not_available' END AS enrichment FROM e""")
def entity_enrichment(spark, sf_dir):
    """One enrichment for each type of entity (SF-40)."""
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "PHONE").when(k % 4 == 1, "UPI").when(k % 4 == 2, "URL").otherwise("OTHER")
    e = read(spark, sf_dir, "customer").select(k.alias("id"), kind.alias("kind"), F.when(k % 4 == 0, "7012345678").when(k % 4 == 1, "x@ybl").otherwise(F.concat(F.lit("http://s"), k.cast("string"), F.lit(".xyz"))).alias("value"))
    v = F.col("value")
    found = F.when(F.col("kind") == "PHONE", T.carrier(v)).when(F.col("kind") == "UPI", T.upi_bank(v)).when(F.col("kind") == "URL", F.array_join(T.url_threats(v), ",")).otherwise("not_available")
    return e.select("id", "kind", found.alias("enrichment"))


@query()
def ocr_postfixed(spark, sf_dir):
    """Recognised texts after spacing fixes (SF-23); word boundaries differ between dialects, tests hold the values."""
    return read(spark, sf_dir, "documents").select("doc_id", T.stable_id(T.ocr_postfix(F.col("text"))).alias("fixed_id"))


@query()
def siamese_pairs(spark, sf_dir):
    """Similarity of each channel's fingerprint and the next one's by an encoder trained on drawn pairs (UD-2, UD-3).

    Training takes at most 300 pairs of one category and 800 others; a learned model, so rows only.
    """
    from vigilspark.operators import siamese
    from vigilspark.operators.pairs import labelled_pairs, with_fingerprints
    from vigilspark.plans.behaviour_plans import fingerprint28
    from vigilspark.plans.link_plans import labelled_channels
    from vigilspark.storage import materialize

    wide = fingerprint28(spark, sf_dir)
    f = materialize(wide.select("channel", F.array(*[c for c in wide.columns if c != "channel"]).alias("vector")), "fingerprints")
    drawn = with_fingerprints(labelled_pairs(labelled_channels(spark, sf_dir), 300, 800), f)
    layers = siamese.fit_contrastive(drawn, epochs=10, batches=2)
    nxt = f.select((F.col("channel") - 1).alias("channel"), F.col("vector").alias("vector_b"))
    return siamese.similarity(f.withColumnRenamed("vector", "vector_a").join(nxt, "channel"), layers).select("channel", "similarity")
