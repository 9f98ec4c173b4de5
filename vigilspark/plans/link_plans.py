"""Queries that link posts, channels, identities and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import scores as S
from vigilspark.functions import text as T
from vigilspark.operators import behaviour as B
from vigilspark.operators import linking as L
from vigilspark.operators.components import connected_components
from vigilspark.operators.folds import ordered_sha256
from vigilspark.operators.neighbours import nearest
from vigilspark.operators.pairs import labelled_pairs
from vigilspark.plans.case_plans import COMPLAINTS, complaints
from vigilspark.plans.testbed import CHANNEL_ENTITIES, CONTACT_POINTS, ENTITIES, POSTS, channel_entities, channel_posts, contact_points, entities, read
from vigilspark.plans.text_plans import TEN, UPI_SQL, URL_SQL, _re
from vigilspark.storage import materialize

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query(f"""WITH {CHANNEL_ENTITIES} SELECT entity_type, value, CAST(count(*) AS INTEGER) AS n_channels, array_to_string(list_sort(list(channel)), ',') AS channels
  FROM channel_entities GROUP BY 1, 2 HAVING count(*) >= 2""")
def shared_entities(spark, sf_dir):
    return L.shared_entities(channel_entities(spark, sf_dir)).withColumn("channels", F.array_join(F.transform("channels", lambda c: c.cast("string")), ","))


BLOCKED = """blocked AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'UPI' ELSE 'URL' END AS entity_type,
    CASE p_partkey % 3 WHEN 0 THEN 'phone-' WHEN 1 THEN 'upi-' ELSE 'url-' END || CAST(p_partkey AS VARCHAR) AS value, 'advisory-' || CAST(p_size AS VARCHAR) AS advisory_id FROM part)"""


def blocklist(spark, sf_dir):
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "PHONE").when(key % 3 == 1, "UPI").otherwise("URL")
    return read(spark, sf_dir, "part").select(
        kind.alias("entity_type"), F.concat(F.lower(kind), F.lit("-"), key.cast("string")).alias("value"), F.concat(F.lit("advisory-"), F.col("p_size").cast("string")).alias("advisory_id")
    )


@query(f"WITH {CHANNEL_ENTITIES}, {BLOCKED} SELECT channel, entity_type, value, advisory_id FROM channel_entities JOIN blocked USING (entity_type, value)")
def blocklist_exact(spark, sf_dir):
    return L.blocklist_exact(channel_entities(spark, sf_dir), blocklist(spark, sf_dir)).select("channel", "entity_type", "value", "advisory_id")


DOMAINS = ["spam-farm.example.org", "blog.", "example.net", "m.th", "zz.invalid"]
DOMAINS_SQL = "domains(domain) AS (VALUES " + ", ".join(f"('{d}')" for d in DOMAINS) + ")"


def _pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")


def _domains(spark):
    return spark.createDataFrame([(d,) for d in DOMAINS], "domain string")


@query(f"WITH {DOMAINS_SQL} SELECT page_id AS id, min(domain) AS domain FROM pages JOIN domains ON contains(url, domain) GROUP BY 1")
def blocklist_substring_first(spark, sf_dir):
    return L.blocklist_substring(_pages(spark, sf_dir), _domains(spark), first_only=True)


@query(f"WITH {DOMAINS_SQL} SELECT page_id AS id, domain FROM pages JOIN domains ON contains(url, domain)")
def blocklist_substring(spark, sf_dir):
    return L.blocklist_substring(_pages(spark, sf_dir), _domains(spark), first_only=False)


_LINKS = URL_SQL.replace("html || ' ' || url", "text")
POST_ENTITIES = f"""linked AS (SELECT doc_id, source, text || ' ' || coalesce(url, '') AS text FROM documents LEFT JOIN pages ON page_id = doc_id % (SELECT count(*) FROM pages)),
  post_entities AS (SELECT DISTINCT doc_id AS post, unnest(list_concat({TEN}, {UPI_SQL}, list_concat(list_transform(regexp_extract_all(text, {_re(X.TELEGRAM_LINK)}, 1), lambda x: 't.me/' || x),
    list_transform(list_filter(regexp_extract_all(text, {_re(X.TELEGRAM_MENTION)}, 1), lambda x: lower(x) NOT IN ('gmail', 'yahoo', 'hotmail', 'email')), lambda x: '@' || x), list_filter({_LINKS}, lambda x: length(x) > 10)))) AS entity FROM linked)"""


def post_entities(spark, sf_dir):
    """(post, entity) of posts, each a document with the address of a page: phones, payment addresses, channel links and addresses of over ten characters."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    number = pages.agg(F.count("*").alias("n"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), "text").crossJoin(F.broadcast(number)).withColumn("page_id", F.col("post") % F.col("n"))
    linked = docs.join(pages, "page_id", "left")
    return L.entities_of_posts(linked.select("post", F.concat("text", F.lit(" "), F.coalesce("url", F.lit(""))).alias("text")))


@query(f"WITH {POST_ENTITIES} SELECT DISTINCT x.post AS a, y.post AS b FROM post_entities x JOIN post_entities y ON x.entity = y.entity AND x.post < y.post")
def cooccurrence_pairs(spark, sf_dir):
    return L.cooccurring_posts(post_entities(spark, sf_dir))


COMPONENTS = f"""{POST_ENTITIES}, edges AS (SELECT DISTINCT x.post AS a, y.post AS b FROM post_entities x JOIN post_entities y ON x.entity = y.entity AND x.post <> y.post),
  reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
  components AS (SELECT node AS post, min(other) AS component FROM reach GROUP BY 1)"""


def post_components(spark, sf_dir, found_entities=None):
    """(post, component) of every document (GR-1); posts without a common entity are their own component."""
    found_entities = materialize(post_entities(spark, sf_dir), "post_entities") if found_entities is None else found_entities
    found = connected_components(L.post_links(found_entities))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"))
    return docs.join(found, docs.post == found.node, "left").select("post", F.coalesce("component", "post").alias("component"))


@query(f"WITH RECURSIVE {COMPONENTS} SELECT post, component FROM components")
def campaign_components(spark, sf_dir):
    return post_components(spark, sf_dir)


RISK_SQL = "CASE WHEN {0} >= 75 THEN 'CRITICAL' WHEN {0} >= 50 THEN 'HIGH' WHEN {0} >= 25 THEN 'MEDIUM' ELSE 'LOW' END"


@query(f"""WITH RECURSIVE {COMPONENTS}, e AS (SELECT component, count(DISTINCT entity) AS entities FROM post_entities JOIN components USING (post) GROUP BY 1),
  g AS (SELECT component, count(*) AS posts, count(DISTINCT source) AS platforms, CAST(sum(n_chars) AS BIGINT) AS reach, min(doc_id) AS first_post,
    'cpg-' || substr(sha256(string_agg(CAST(doc_id AS VARCHAR), '' ORDER BY CAST(doc_id AS VARCHAR))), 1, 8) AS campaign_id FROM documents JOIN components ON post = doc_id GROUP BY 1),
  s AS (SELECT *, coalesce(e.entities, 0) AS n_entities, round(least(100.0, least(40, posts * 3) + least(30, coalesce(e.entities, 0) * 5) + least(20, platforms * 7) + least(10.0, reach / 10000)), 1) AS risk_score FROM g LEFT JOIN e USING (component))
  SELECT campaign_id, posts, n_entities, platforms, reach, greatest(1, CAST(floor(reach * 0.01) AS BIGINT)) AS victims, first_post, risk_score, {RISK_SQL.format("risk_score")} AS risk_level FROM s""")
def campaign_rollup(spark, sf_dir):
    """Posts, entities, platforms, reach and risk of each campaign (AG-23, AG-24, AG-28, DM-12)."""
    linked = materialize(post_entities(spark, sf_dir), "post_entities")  # three parts read it, texts are searched once
    comps = post_components(spark, sf_dir, linked)
    found = linked.join(comps, "post").groupBy("component").agg(F.count_distinct("entity").alias("n_entities"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("post"), "source", "n_chars").join(comps, "post")
    ids = ordered_sha256(docs.select("component", F.col("post").cast("string").alias("post")), "component", "post")
    g = docs.groupBy("component").agg(
        F.count("*").alias("posts"), F.count_distinct("source").alias("platforms"), F.sum("n_chars").alias("reach"), F.min("post").alias("first_post"),
    )
    g = g.join(ids.select("component", F.concat(F.lit("cpg-"), F.substring("digest", 1, 8)).alias("campaign_id")), "component")
    g = g.join(found, "component", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)).cast("long"))
    scored = g.withColumn("risk_score", S.campaign_risk(F.col("posts"), F.col("n_entities"), F.col("platforms"), F.col("reach")))
    return scored.select(
        "campaign_id", "posts", "n_entities", "platforms", "reach", F.greatest(F.lit(1), F.floor(F.col("reach") * 0.01)).cast("long").alias("victims"), "first_post", "risk_score", S.risk_level(F.col("risk_score")).alias("risk_level")
    )


JACCARD = f"""{CONTACT_POINTS}, sizes AS (SELECT channel, entity_type, count(*) AS n FROM points GROUP BY 1, 2),
  common AS (SELECT x.channel AS a, y.channel AS b, x.entity_type, count(*) AS common FROM points x JOIN points y ON x.entity_type = y.entity_type AND x.value = y.value AND x.channel < y.channel GROUP BY 1, 2, 3),
  j AS (SELECT a, b, c.entity_type, common / (p.n + q.n - common) AS j FROM common c JOIN sizes p ON p.channel = a AND p.entity_type = c.entity_type JOIN sizes q ON q.channel = b AND q.entity_type = c.entity_type),
  jaccard AS (SELECT a, b, coalesce(max(j) FILTER (WHERE entity_type = 'UPI'), 0.0) AS j_upi, coalesce(max(j) FILTER (WHERE entity_type = 'PHONE'), 0.0) AS j_phone, coalesce(max(j) FILTER (WHERE entity_type = 'URL'), 0.0) AS j_domain,
    coalesce(max(j) FILTER (WHERE entity_type = 'IMAGE'), 0.0) AS j_image FROM j GROUP BY 1, 2)"""


@query(f"WITH {JACCARD} SELECT a, b, round(j_upi, 6) AS j_upi, round(j_phone, 6) AS j_phone, round(j_domain, 6) AS j_domain, round(j_image, 6) AS j_image FROM jaccard")
def jaccard_pairs(spark, sf_dir):
    j = L.jaccard_by_type(contact_points(spark, sf_dir))
    return j.select("a", "b", *[F.round(c, 6).alias(c) for c in L.JACCARD_KINDS.values()])


PROFILE = f"""k AS (SELECT channel, count(*) FILTER (WHERE entity_type = 'UPI') AS upis, count(*) FILTER (WHERE entity_type = 'PHONE') AS phones, count(*) FILTER (WHERE entity_type = 'URL') AS urls FROM channel_entities GROUP BY 1),
  p AS (SELECT channel, count(*) AS n, min(ts) AS t0, max(ts) AS t1, 1 - count(*) / (max(message_id) - min(message_id) + 1) AS del, avg(forwards) AS fw FROM posts GROUP BY 1),
  profile AS (SELECT k.channel, [(CAST(upis > 0 AS INTEGER) + CAST(phones > 0 AS INTEGER)) / 3, least(urls / 50, 1.0), least(phones / 20, 1.0), least(upis / 20, 1.0), 0.0, coalesce(round(del, 4), 0.0), coalesce(round(fw, 3), 0.0)]::DOUBLE[] AS vector,
    CASE WHEN k.channel % 8 = 7 THEN 'UNKNOWN' ELSE 'CATEGORY_' || CAST(k.channel % 7 AS VARCHAR) END AS category, CASE WHEN k.channel % 5 = 0 THEN 'SBI' ELSE '' END AS impersonated, k.channel % 2 = 0 AS promises,
    CASE WHEN k.channel % 3 = 0 THEN t1 END AS taken_down, t0 + INTERVAL 30 DAY AS created, CAST(k.channel % 4 AS BIGINT) AS n_evidence FROM k LEFT JOIN p USING (channel))"""


def channel_profiles(spark, sf_dir):
    """What attribution compares: stable behaviour features, content marks, times (tier 1 and 2 of the evidence)."""
    k = B.entity_counts(channel_entities(spark, sf_dir))
    posts = channel_posts(spark, sf_dir)
    p = B.counters(posts).select("channel", "deletion_rate", "forward_ratio").join(posts.groupBy("channel").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1")), "channel")
    c = F.col("channel")
    kinds = ((F.col("upis") > 0).cast("int") + (F.col("phones") > 0).cast("int")) / 3
    capped = [F.least(F.col(n) / d, F.lit(1.0)) for n, d in (("urls", 50), ("phones", 20), ("upis", 20))]
    vector = F.array(kinds, *capped, F.lit(0.0), F.coalesce("deletion_rate", F.lit(0.0)), F.coalesce("forward_ratio", F.lit(0.0)))
    return k.join(p, "channel", "left").select(
        "channel", vector.alias("vector"), F.when(c % 8 == 7, "UNKNOWN").otherwise(F.concat(F.lit("CATEGORY_"), (c % 7).cast("string"))).alias("category"),
        F.when(c % 5 == 0, "SBI").otherwise("").alias("impersonated"), (c % 2 == 0).alias("promises"), F.when(c % 3 == 0, F.col("t1")).alias("taken_down"),
        (F.col("t0") + F.expr("INTERVAL 30 DAYS")).alias("created"), (c % 4).alias("n_evidence"),
    )


_SE = "(3.141592653589793 / (1.7320508075688772 * greatest(sqrt(n), 1.0)))"
ATTRIBUTION = f"""{JACCARD}, {POSTS}, {PROFILE},
  parts AS (SELECT x.channel AS a, y.channel AS b, coalesce(0.4 * j_upi + 0.3 * j_phone + 0.2 * j_domain + 0.1 * j_image, 0.0) AS infra, (list_cosine_similarity(x.vector, y.vector) + 1) / 2 AS behaviour,
    coalesce(exp(-abs((epoch_us(y.created) - epoch_us(x.taken_down)) / 3600000000) / 48), 0.0) AS temporal,
    CASE WHEN x.category <> 'UNKNOWN' AND x.category = y.category THEN 0.4 ELSE 0 END + CASE WHEN x.impersonated <> '' AND x.impersonated = y.impersonated THEN 0.4 ELSE 0 END
    + CASE WHEN x.promises AND y.promises THEN 0.2 ELSE 0 END AS content, x.n_evidence + y.n_evidence AS n FROM profile x JOIN profile y ON x.channel < y.channel LEFT JOIN jaccard ON a = x.channel AND b = y.channel),
  odds AS (SELECT *, -4.0 + 3.0 * infra + behaviour + 2.0 * temporal + 0.5 * content + 1.5 * infra * temporal AS o FROM parts),
  pairs AS (SELECT a, b, round(infra, 4) AS infra, round(behaviour, 4) AS behaviour, round(temporal, 4) AS temporal, round(content::DOUBLE, 4) AS content, round(1 / (1 + exp(-o)), 4) AS probability,
    round(1 / (1 + exp(-(o - 1.645 * {_SE}))), 4) AS ci_low, round(1 / (1 + exp(-(o + 1.645 * {_SE}))), 4) AS ci_high,
    CASE WHEN 1 / (1 + exp(-o)) >= 0.95 THEN 'DEFINITIVE' WHEN 1 / (1 + exp(-o)) >= 0.8 THEN 'STRONG' WHEN 1 / (1 + exp(-o)) >= 0.6 THEN 'PROBABLE' WHEN 1 / (1 + exp(-o)) >= 0.4 THEN 'POSSIBLE' ELSE 'INSUFFICIENT' END AS strength FROM odds)"""


@query(f"WITH {ATTRIBUTION} SELECT * FROM pairs WHERE probability >= 0.08")
def attribution_pairs(spark, sf_dir):
    return L.attribution(channel_profiles(spark, sf_dir), contact_points(spark, sf_dir), 0.08)


@query(f"""WITH RECURSIVE {ATTRIBUTION}, e AS (SELECT a, b FROM pairs WHERE probability >= 0.1 UNION SELECT b, a FROM pairs WHERE probability >= 0.1),
  reach(node, other) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other)
  SELECT node AS channel, min(other) AS operator_id FROM reach GROUP BY 1""")
def operator_clusters(spark, sf_dir):
    """Channels of one presumed operator: components of attribution pairs (GR-2, in place of order-dependent merging, JN-24)."""
    found = L.operator_components(channel_profiles(spark, sf_dir), contact_points(spark, sf_dir), 0.1)
    return found.select(F.col("node").alias("channel"), F.col("component").alias("operator_id"))


PLATFORMS = "platformed AS (SELECT *, (['telegram', 'instagram', 'facebook'])[CAST(channel % 3 AS INTEGER) + 1] AS platform FROM entities)"


@query(f"""WITH {ENTITIES}, {PLATFORMS}, g AS (SELECT entity_type, value, list_sort(list(DISTINCT platform)) AS ps, count(*) AS occurrences, min(channel) AS c FROM platformed WHERE entity_type IN ('PHONE', 'UPI') GROUP BY 1, 2)
  SELECT entity_type, value, array_to_string(ps, ',') AS platforms, occurrences, round(least(0.98, 0.7 + len(ps) * 0.1)::DOUBLE, 4) AS probability, 'Operator via ' || CAST(c AS VARCHAR) AS operator FROM g WHERE len(ps) >= 2""")
def identity_exact(spark, sf_dir):
    names = F.array(*[F.lit(p) for p in ("telegram", "instagram", "facebook")])
    return L.identity_exact(entities(spark, sf_dir).withColumn("platform", F.get(names, (F.col("channel") % 3).cast("int"))))


@query()
def identity_fuzzy(spark, sf_dir):
    """Similar names across platforms (JN-8, DM-14); an Arrow function scores, so rows only."""
    p = read(spark, sf_dir, "part")
    names = p.select(F.concat_ws("_", F.split("p_name", " ")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "telegram").otherwise("instagram").alias("platform")).distinct()
    return L.identity_fuzzy(names)


IMAGES = """i AS (SELECT c_custkey AS id, xor(CAST('0x' || substr(sha256(CAST(c_custkey // 5 AS VARCHAR)), 1, 15) AS BIGINT), ([0, 3, 28, 480, 7680])[CAST(c_custkey % 5 AS INTEGER) + 1]::BIGINT) AS h FROM customer)"""


def image_hashes(spark, sf_dir):
    """(id, phash): spread hashes in families whose members differ by up to eight bits."""
    k = F.col("c_custkey")
    base = F.conv(F.substring(F.sha2(F.floor(k / 5).cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long")
    noise = F.get(F.array(*[F.lit(n).cast("long") for n in (0, 3, 28, 480, 7680)]), (k % 5).cast("int"))
    return read(spark, sf_dir, "customer").select(k.alias("id"), base.bitwiseXOR(noise).alias("phash"))


@query(f"""WITH {IMAGES} SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance
  FROM i x JOIN i y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 4""")
def phash_pairs(spark, sf_dir):
    """Images within four bits of each other (JN-12)."""
    return L.phash_all_pairs(image_hashes(spark, sf_dir), bits=4)


@query()
def dedup_fuzzy(spark, sf_dir):
    """First-seen deduplication by hashes within four bits (WN-4): the order of posts decides, so the SQL of the cascade and brute force test it."""
    return L.first_seen_fuzzy(image_hashes(spark, sf_dir)).select("id", "canonical", "duplicate")


@query("""WITH p AS (SELECT page_id, sha256(regexp_replace(lower(url), '[?#].*$', '')) AS url_key, sha256(substr(html, 1, 200)) AS content_key FROM pages),
  a AS (SELECT *, min(page_id) OVER (PARTITION BY url_key) AS f1 FROM p), b AS (SELECT *, page_id > f1 AS d1 FROM a),
  c AS (SELECT *, min(page_id) FILTER (WHERE NOT d1) OVER (PARTITION BY content_key) AS f2 FROM b)
  SELECT page_id, d1 OR page_id > f2 AS duplicate, CASE WHEN d1 THEN 'url_key' WHEN page_id > f2 THEN 'content_key' END AS reason, CASE WHEN d1 THEN f1 WHEN page_id > f2 THEN f2 END AS canonical FROM c""")
def dedup_cascade(spark, sf_dir):
    """First-seen deduplication by address, then by content (WN-4, WN-5, SE-1)."""
    url = F.regexp_replace(F.lower("url"), "[?#].*$", "")
    pages = read(spark, sf_dir, "pages").select(
        "page_id", F.sha2(url.cast("binary"), 256).alias("url_key"), F.sha2(F.substring("html", 1, 200).cast("binary"), 256).alias("content_key")
    )
    return L.first_seen_cascade(pages, ["url_key", "content_key"], "page_id").select("page_id", "duplicate", "reason", "canonical")


@query("""WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY page_id) AS n, page_id AS id, sha256(regexp_replace(lower(url), '[?#].*$', '')) AS u, sha256(substr(html, 1, 200)) AS t,
    xor(CAST('0x' || substr(sha256(CAST(page_id // 5 AS VARCHAR)), 1, 15) AS BIGINT), ([0, 3, 28, 480, 7680])[CAST(page_id % 5 AS INTEGER) + 1]::BIGINT) AS h FROM pages),
  s AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST([] AS VARCHAR[]) AS urls, CAST([] AS STRUCT(id BIGINT, h BIGINT)[]) AS hashes, CAST([] AS VARCHAR[]) AS texts, CAST(NULL AS VARCHAR) AS signal, CAST(NULL AS VARCHAR) AS canonical
    UNION ALL SELECT n, id, CASE WHEN seen THEN urls ELSE list_append(urls, u) END, CASE WHEN seen OR near IS NOT NULL THEN hashes ELSE list_append(hashes, {'id': id, 'h': h}) END,
      CASE WHEN seen OR near IS NOT NULL OR told THEN texts ELSE list_append(texts, t) END, CASE WHEN seen THEN 'url' WHEN near IS NOT NULL THEN 'phash' WHEN told THEN 'content' END,
      CASE WHEN seen THEN substr(u, 1, 8) WHEN near IS NOT NULL THEN CAST(near AS VARCHAR) WHEN told THEN substr(t, 1, 8) END
    FROM (SELECT p.*, s.urls, s.hashes, s.texts, list_contains(s.urls, u) AS seen, list_contains(s.texts, t) AS told, list_filter(s.hashes, lambda x: bit_count(xor(x.h, p.h)) <= 4)[1].id AS near FROM s JOIN p ON p.n = s.n + 1))
  SELECT id, signal IS NOT NULL AS duplicate, signal, canonical FROM s WHERE id IS NOT NULL""")
def dedup_posts(spark, sf_dir):
    """First-seen deduplication by address, near image and text in one cascade (WN-4)."""
    k = F.col("page_id")
    base = F.conv(F.substring(F.sha2(F.floor(k / 5).cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long")
    noise = F.get(F.array(*[F.lit(n).cast("long") for n in (0, 3, 28, 480, 7680)]), (k % 5).cast("int"))
    url = F.regexp_replace(F.lower("url"), "[?#].*$", "")
    return L.dedup_posts(read(spark, sf_dir, "pages").select(k.alias("id"), url.alias("url"), base.bitwiseXOR(noise).alias("phash"), F.col("html").alias("text")))


@query("""WITH d AS (SELECT doc_id, sha256(substr(text, 1, 200)) AS k FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS canonical, doc_id > min(doc_id) OVER (PARTITION BY k) AS duplicate FROM d""")
def dedup_exact(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.substring("text", 1, 200).cast("binary"), 256).alias("k"))
    first = docs.groupBy("k").agg(F.min("doc_id").alias("canonical"))  # pre-aggregated, where a window would gather a hot key
    return docs.join(first, "k").select("doc_id", "canonical", (F.col("doc_id") > F.col("canonical")).alias("duplicate"))


@query("""WITH k AS (SELECT page_id, substr(sha256(url), 1, 16) AS url_hash FROM pages), seen AS (SELECT DISTINCT url_hash FROM k WHERE page_id < (SELECT avg(page_id) FROM pages))
  SELECT page_id, url_hash FROM k WHERE url_hash NOT IN (SELECT url_hash FROM seen)""")
def url_first_seen(spark, sf_dir):
    """Rows not ingested before (JN-16, SE-5, SC-20)."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    middle = pages.agg(F.avg("page_id")).first()[0]  # the first half was seen
    seen = pages.where(F.col("page_id") < F.lit(middle)).select(T.stable_id(F.col("url")).alias("url_hash"))
    return L.unseen(pages, seen, T.stable_id(F.col("url")), "url_hash").select("page_id", "url_hash")


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS similarity
    FROM e q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM s WHERE similarity >= 0.1)
  SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 5""")
def cosine_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest(e, e.where("id % 50 = 0"), k=5, threshold=0.1)


@query(f"""WITH {COMPLAINTS}, {CHANNEL_ENTITIES}, keys AS (SELECT DISTINCT complaint_id, telegram AS value FROM complaints WHERE telegram <> '' UNION SELECT DISTINCT complaint_id, upi FROM complaints WHERE upi IS NOT NULL),
  camp AS (SELECT 't.me/g' || CAST(channel AS VARCHAR) AS value, channel AS campaign FROM (SELECT DISTINCT channel FROM channel_entities))
  SELECT complaint_id, campaign, count(*) AS common FROM keys JOIN camp USING (value) GROUP BY 1, 2""")
def complaint_campaign_links(spark, sf_dir):
    """Complaints that name an entity of a campaign (JN-14, DM-24)."""
    c = complaints(spark, sf_dir)
    keys = c.select("complaint_id", F.explode(F.array_compact(F.array(F.nullif("telegram", F.lit("")), F.col("upi")))).alias("value")).distinct()
    camp = channel_entities(spark, sf_dir).select("channel").distinct().select(F.concat(F.lit("t.me/g"), F.col("channel").cast("string")).alias("value"), F.col("channel").alias("campaign"))
    return keys.join(camp, "value").groupBy("complaint_id", "campaign").agg(F.count("*").alias("common"))


_LABELLED = """l AS (SELECT s_suppkey AS channel, CASE WHEN s_nationkey >= 18 THEN 'CONFIRMED_LEGITIMATE' ELSE 'CONFIRMED_SCAM' END AS label, 'category-' || CAST(s_nationkey % 5 AS VARCHAR) AS category FROM supplier)"""


def labelled_channels(spark, sf_dir):
    """(channel, label, category) of the suppliers."""
    nation = F.col("s_nationkey")
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("channel"), F.when(nation >= 18, "CONFIRMED_LEGITIMATE").otherwise("CONFIRMED_SCAM").alias("label"), F.concat(F.lit("category-"), (nation % 5).cast("string")).alias("category")
    )


@query(f"""WITH {_LABELLED} SELECT x.channel AS a, y.channel AS b, 1 AS label, 'same_category' AS pair_type FROM l x JOIN l y ON x.category = y.category AND x.channel < y.channel AND x.label = y.label WHERE x.label = 'CONFIRMED_SCAM'
  UNION ALL SELECT x.channel, y.channel, 0, 'cross_category' FROM l x JOIN l y ON x.category < y.category WHERE x.label = 'CONFIRMED_SCAM' AND y.label = 'CONFIRMED_SCAM'
  UNION ALL SELECT x.channel, y.channel, 0, 'scam_vs_legit' FROM l x JOIN l y ON x.label = 'CONFIRMED_SCAM' AND y.label = 'CONFIRMED_LEGITIMATE'""")
def training_pairs(spark, sf_dir):
    """All pairs for a similarity model by kind and label (JN-19 to JN-22)."""
    return labelled_pairs(labelled_channels(spark, sf_dir), None, None)


@query(f"""WITH {_LABELLED}, s AS (SELECT category, count(*) AS n FROM l WHERE label = 'CONFIRMED_SCAM' GROUP BY 1), t AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS same, CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) AS cross_n, CAST(sum(n) AS BIGINT) AS n FROM s),
  f AS (SELECT count(*) AS m FROM l WHERE label = 'CONFIRMED_LEGITIMATE') SELECT 1 AS label, least(300, same) AS pairs FROM t UNION ALL SELECT 0, least(800, cross_n + n * m) FROM t, f""")
def training_pairs_sampled(spark, sf_dir):
    """How many distinct pairs a draw with caps gives by label; which ones the seed decides."""
    some = labelled_pairs(labelled_channels(spark, sf_dir), 300, 800)
    return some.distinct().groupBy("label").agg(F.count("*").alias("pairs"))
