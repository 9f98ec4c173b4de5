"""Queries on post texts and page addresses: extraction, masking, classification."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import text as T
from vigilspark.functions.words import weighted_classes, word_numbers
from vigilspark.plans.case_plans import ENTITIES, entities
from vigilspark.plans.testbed import channel_texts, read, sql_any, sql_list

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _joined(name, column):
    return F.array_join(column, ",").alias(name)


SET = "array_to_string(list_sort(list_distinct({0})), ',')"


def _set_of(expr: str) -> str:
    return SET.format(expr)


TEN = f"list_filter(list_transform(regexp_extract_all(text, {_re(X.PHONE)}), lambda x: right(regexp_replace(x, '[^0-9]', '', 'g'), 10)), lambda x: regexp_matches(x, '^[6-9]'))"
UPI_SQL = (
    f"list_filter(list_transform(regexp_extract_all(text, {_re(X.UPI)}), lambda x: lower(x)), "
    f"lambda x: NOT regexp_matches(x, '{'|'.join(X.MAIL_PROVIDERS)}') AND length(split_part(x, '@', 2)) <= 10)"
)


@query(f"WITH e AS (SELECT doc_id, {_set_of(TEN)} AS phones FROM documents) SELECT * FROM e WHERE phones <> ''")
def phones_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined("phones", T.phones(F.col("text")))).where("phones <> ''")


@query(f"WITH e AS (SELECT doc_id, {_set_of(UPI_SQL)} AS upis FROM documents) SELECT * FROM e WHERE upis <> ''")
def upi_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined("upis", T.upis(F.col("text")))).where("upis <> ''")


URL_SQL = (
    f"list_filter(list_transform(regexp_extract_all(html || ' ' || url, {_re(X.URL)}), "
    "lambda x: regexp_replace(x, '^[.,;:!?)\\]}>\"'']+|[.,;:!?)\\]}>\"'']+$', '', 'g')), lambda x: length(x) > 8)"
)


@query(f"SELECT page_id, {_set_of(URL_SQL)} AS urls FROM pages")
def urls_extract(spark, sf_dir):
    both = F.concat_ws(" ", "html", "url")
    return read(spark, sf_dir, "pages").select("page_id", _joined("urls", T.urls(both)))


def _mask_sql() -> str:
    out = "text"
    for pattern, mask in X.MASKS:
        out = f"regexp_replace({out}, {_re(pattern)}, '{mask}', 'g')"
    return out


@query(f"WITH m AS (SELECT doc_id, text, {_mask_sql()} AS masked FROM documents) SELECT doc_id, sha256(masked) AS masked_sha256, masked <> text AS changed FROM m")
def pii_mask(spark, sf_dir):
    masked = _docs(spark, sf_dir).select("doc_id", "text", T.mask_pii(F.col("text")).alias("masked"))
    return masked.select("doc_id", F.sha2(F.col("masked").cast("binary"), 256).alias("masked_sha256"), (F.col("masked") != F.col("text")).alias("changed"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[ऀ-ॿ]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)
  SELECT doc_id, CASE WHEN d + l = 0 THEN 'unknown' WHEN d / (d + l) > 0.6 THEN 'hindi' WHEN d / (d + l) > 0.2 THEN 'hinglish' ELSE 'english' END AS script FROM c""")
def language_script(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.script_language(F.col("text")).alias("script"))


AMOUNT_SQL = (
    f"list_transform(list_filter(list_transform(regexp_extract_all(t, {_re(X.AMOUNT)}), "
    r"lambda x: replace(regexp_extract(x, '\d[\d,]*(?:\.\d{1,2})?'), ',', '')), lambda x: TRY_CAST(x AS DOUBLE) > 0), lambda x: '₹' || x)"
)
PRICED = "priced AS (SELECT o_orderkey AS id, 'pay Rs. ' || CAST(o_totalprice AS VARCHAR) || ' or ' || CAST(o_custkey AS VARCHAR) || ' rupees to ' || o_orderpriority AS t FROM orders)"


@query(f"WITH {PRICED} SELECT id, {_set_of(AMOUNT_SQL)} AS amounts FROM priced")
def amounts_extract(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    t = F.concat(F.lit("pay Rs. "), F.col("o_totalprice").cast("string"), F.lit(" or "), F.col("o_custkey").cast("string"), F.lit(" rupees to "), F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), _joined("amounts", T.amounts(t)))


@query(f"""WITH e AS (SELECT doc_id, CASE WHEN regexp_matches(text, {_re(X.BANK_WORDS)}) THEN
    {_set_of(f"list_filter(regexp_extract_all(text, {_re(X.BANK_ACCOUNT)}, 1), lambda x: NOT regexp_matches(right(x, 10), '^[6-9]'))")} ELSE '' END AS accounts FROM documents)
  SELECT * FROM e WHERE accounts <> ''""")
def bank_accounts_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined("accounts", T.bank_accounts(F.col("text")))).where("accounts <> ''")


@query(f"""WITH e AS (SELECT doc_id, array_to_string(list_distinct(list_transform(regexp_extract_all(text, '(?:\\+91[-\\s]?)?[6-9]\\d{{9}}'), lambda x: 'PHONE:' || x)), ',') AS p FROM documents)
  SELECT doc_id, CAST(len(string_split(p, ',')) AS INTEGER) AS n FROM e WHERE p <> ''""")
def complaint_phones(spark, sf_dir):
    """Complaint extraction, the phone part (SF-16)."""
    found = _docs(spark, sf_dir).select("doc_id", F.filter(T.complaint_entities(F.col("text")), lambda x: x.startswith("PHONE:")).alias("p"))
    return found.where(F.size("p") > 0).select("doc_id", F.size("p").alias("n"))


@query(f"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url || ' CVE-2024-' || CAST(1000 + page_id AS VARCHAR), {_re(X.IOC_DOMAIN)}))), ',') AS domains,
    array_to_string(list_sort(list_distinct(regexp_extract_all(url || ' CVE-2024-' || CAST(1000 + page_id AS VARCHAR), {_re(X.IOC_CVE)}))), ',') AS cves,
    array_to_string(list_sort(list_distinct(regexp_extract_all(url, 'https?://[^\\s<>\"'']+'))), ',') AS urls FROM pages""")
def ioc_extract(spark, sf_dir):
    """Indicators of an alert text (SF-17)."""
    alert = F.concat(F.col("url"), F.lit(" CVE-2024-"), (F.col("page_id") + 1000).cast("string"))
    return read(spark, sf_dir, "pages").select(
        "page_id", _joined("domains", T.iocs(alert, "DOMAIN")), _joined("cves", T.iocs(alert, "CVE")), _joined("urls", T.iocs(F.col("url"), "URL"))
    )


@query(f"""WITH e AS (SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {_re(X.IOC_IP)}))), ',') AS ips FROM documents) SELECT * FROM e WHERE ips <> ''""")
def ip_extract(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined("ips", T.iocs(F.col("text"), "IP"))).where("ips <> ''")


# -- synthetic sentences: part names and numbers give texts in which every keyword family occurs ------------------
_WORDS = ["invest now guaranteed return", "cricket prediction betting tips", "instant loan no documents", "work from home typing job", "lottery winner lucky draw",
          "customer care helpline number", "digital arrest cbi officer court order", "mukesh ambani plan", "private video blackmail", "buy followers, backup at new channel",
          "first copy replica", "torrent links", "weed delivery", "neutral sentence", "double your money zero risk ponzi"]
_LIST = "[" + ", ".join(f"'{w}'" for w in _WORDS) + "]"
CLAIMS = f"""claims AS (SELECT o_orderkey AS id, ({_LIST})[CAST(o_custkey % 15 AS INTEGER) + 1] || ' ' || ({_LIST})[CAST(o_orderkey % 7 AS INTEGER) + 1] AS text, o_custkey AS author FROM orders)"""


def claims(spark, sf_dir):
    """(id, text, author): orders told as claims, one or two keyword phrases each."""
    words = F.array(*[F.lit(w) for w in _WORDS])
    o = read(spark, sf_dir, "orders")
    first, second = F.get(words, (F.col("o_custkey") % 15).cast("int")), F.get(words, (F.col("o_orderkey") % 7).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), F.concat_ws(" ", first, second).alias("text"), F.col("o_custkey").alias("author"))


def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for v, c in pairs) + f" ELSE {default} END"


@query(f"""WITH {CLAIMS} SELECT id, {_case([(f"'{k}'", sql_any('text', w)) for k, w in X.VIOLATIONS], "'OTHER'")} AS violation,
    {_case([(f"'{k}'", sql_any('text', w)) for k, w in X.SEVERITY_WORDS], "'MEDIUM'")} AS severity FROM claims""")
def violation_severity(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.violation_type(F.col("text")).alias("violation"), T.severity(F.col("text")).alias("severity"))


@query(f"""WITH {CLAIMS} SELECT id, {_case([(str(k), "regexp_matches(lower(text), '" + chr(92) + "b(?:" + '|'.join(x.replace('-', chr(92) + '-') for x in w) + ")" + chr(92) + "b')") for k, w in X.HEURISTIC_KEYWORDS], "-1")} AS label FROM claims""")
def heuristic_classify(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.heuristic_label(F.col("text")).alias("label"))


def rule_hits_sql(patterns):
    return " + ".join(f"CAST(regexp_matches(lower(text), {_re(p)}) AS INTEGER)" for p in patterns)


@query(f"""WITH {CLAIMS}, h AS (SELECT id, {", ".join(f"{rule_hits_sql(p)} AS h{k}" for k, (_, p) in enumerate(X.RULE_PATTERNS))} FROM claims),
  b AS (SELECT *, greatest({", ".join(f"h{k}" for k in range(len(X.RULE_PATTERNS)))}) AS best FROM h)
  SELECT id, CASE WHEN best < 2 THEN 'UNKNOWN' {" ".join(f"WHEN h{k} = best THEN '{n}'" for k, (n, _) in enumerate(X.RULE_PATTERNS))} END AS category FROM b""")
def rule_category(spark, sf_dir):
    return claims(spark, sf_dir).select("id", T.rule_category(F.col("text")).alias("category"))


def keyword_rows():
    """(category, position, keyword, weight): the taxonomy as rows (SC-5); longer phrases weigh more."""
    return [
        Row(category=cid, position=k, keyword=word.lower(), weight=2.5 if len(word.split()) >= 2 else 1.0)
        for k, (cid, *_, english, hindi) in enumerate(X.CATEGORIES) for word in [*english, *hindi]
    ]


KEYWORDS = "keywords(category, position, keyword, weight) AS (VALUES " + ", ".join(
    f"('{cid}', {k}, '{w.lower()}', {2.5 if len(w.split()) >= 2 else 1.0})" for k, (cid, *_, en, hi) in enumerate(X.CATEGORIES) for w in [*en, *hi]
) + ")"


def taxonomy(texts, keywords):
    """Keyword taxonomy classifier (DM-17, JN-18, WN-11/12): best category, its share of all scores, second if over 30 % of the best.

    ``keywords``: rows (category, position, keyword, weight) of the fixed list.  One pass of an automaton
    over a text gives all keywords; scores follow in the same row, so nothing is shuffled.
    """
    names = [category for _, category in sorted({(r.position, r.category) for r in keywords})]
    number = {name: k for k, name in enumerate(names)}
    hits = word_numbers([r.keyword for r in keywords])(F.lower("text"))
    sums = weighted_classes(F.col("hits"), [number[r.category] for r in keywords], [r.weight for r in keywords], len(names))
    ranked = F.array_sort(F.filter(F.transform("sums", lambda s, k: F.struct((-s).alias("neg"), k.alias("k"))), lambda x: x["neg"] < 0))
    total = F.aggregate("sums", F.lit(0.0), lambda a, s: a + s)
    name = lambda x: F.get(F.array(*[F.lit(n) for n in names]), x["k"])
    scored = texts.select("id", hits.alias("hits")).select("id", sums.alias("sums")).select("id", ranked.alias("r"), total.alias("total"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return scored.select(
        "id", F.coalesce(name(first), F.lit("unknown")).alias("category"),
        F.coalesce(F.round(F.least(F.lit(0.99), -first["neg"] / F.col("total") + 0.3), 3), F.lit(0.1)).alias("confidence"),
        F.coalesce(F.when(second["neg"] < first["neg"] * 0.3, name(second)), F.lit("")).alias("secondary"),
    )


@query(f"""WITH {CLAIMS}, {KEYWORDS}, s AS (SELECT id, category, position, sum(weight) AS s FROM claims JOIN keywords ON contains(lower(text), keyword) GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, position) AS n, sum(s) OVER (PARTITION BY id) AS total FROM s)
  SELECT c.id, coalesce(a.category, 'unknown') AS category, coalesce(round(least(0.99, a.s / a.total + 0.3), 3), 0.1) AS confidence,
    coalesce(CASE WHEN b.s > a.s * 0.3 THEN b.category END, '') AS secondary
  FROM claims c LEFT JOIN r a ON a.id = c.id AND a.n = 1 LEFT JOIN r b ON b.id = c.id AND b.n = 2""")
def taxonomy_classify(spark, sf_dir):
    return taxonomy(claims(spark, sf_dir), keyword_rows())


@query(f"""WITH {CLAIMS}, people(name, kind, word) AS (VALUES {", ".join(f"('{n}', '{k}', '{w.lower()}')" for n, k, ws in X.CELEBRITIES for w in (n, *ws))})
  SELECT DISTINCT id, name, kind FROM claims JOIN people ON contains(lower(text), word)""")
def celebrity_join(spark, sf_dir):
    """People named in a text by name or alias, one row for each (JN-17): one projection, no join."""
    return claims(spark, sf_dir).select("id", F.explode(T.celebrities(F.col("text"))).alias("p")).select("id", "p.name", "p.kind")


def _count_sql(words):
    return " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)


@query(f"""WITH {CLAIMS}, k AS (SELECT id, {_count_sql(X.INVESTMENT_WORDS)} AS inv, {_count_sql(X.SEXTORTION_WORDS)} AS sex, {_count_sql(X.ARREST_WORDS)} AS arr,
    {sql_any('text', X.CELEBRITY_WORDS)} AS celeb, {sql_any('text', [w for _, ws in X.DEPARTMENTS for w in ws])} AS dept FROM claims),
  c AS (SELECT id, CASE WHEN celeb AND inv >= 2 THEN round(least(0.95, 0.7 + inv * 0.05)::DOUBLE, 4) ELSE -1 END AS a, CASE WHEN celeb AND inv < 2 THEN 0.49 ELSE -1 END::DOUBLE AS b,
    CASE WHEN sex >= 2 THEN round(least(0.95, 0.5 + sex * 0.1)::DOUBLE, 4) ELSE -1 END AS s, CASE WHEN dept THEN round(least(0.95, 0.4 + arr * 0.1)::DOUBLE + 0.2, 4) ELSE -1 END AS d FROM k), m AS (SELECT *, greatest(a, b, s, d)::DOUBLE AS top FROM c)
  SELECT id, CASE WHEN top <= 0 THEN 'GENERIC_CONTENT' WHEN a = top THEN 'CELEBRITY_INVESTMENT_SCAM' WHEN b = top THEN 'FAKE_ENDORSEMENT' WHEN s = top THEN 'SEXTORTION' ELSE 'DIGITAL_ARREST' END AS category,
    CASE WHEN top <= 0 THEN 0.3::DOUBLE ELSE top END AS confidence, CASE WHEN top <= 0 THEN 'LOW' WHEN a <> top AND b = top THEN 'HIGH' ELSE 'CRITICAL' END AS urgency FROM m""")
def intent_analysis(spark, sf_dir):
    """Intent by the most confident reading (DM-19)."""
    found = claims(spark, sf_dir).select("id", T.intent(F.col("text")).alias("i"))
    return found.select("id", "i.category", "i.confidence", "i.urgency")


SITED = f"""{CLAIMS}, sited AS (SELECT id, text || ' in ' || (['Delhi', 'jamtara', 'Noida', 'nowhere', 'delhigate'])[CAST(author % 5 AS INTEGER) + 1] AS text FROM claims)"""


@query(f"""WITH {SITED}, g AS (SELECT *, regexp_extract(lower(text), {_re(X.PLACES)}, 1) AS place FROM sited)
  SELECT id, {_case([(f"'{n}'", f"regexp_matches(lower(text), {_re(p)})") for n, p in X.CAMPAIGN_NAMES], "'Unidentified Scam Network'")}
    || CASE WHEN place <> '' THEN ' — ' || upper(substr(place, 1, 1)) || substr(place, 2) ELSE '' END AS name,
    {_case([(f"'{n}'", f"regexp_matches(lower(text), {_re(p)})") for n, p in X.CAMPAIGN_CATEGORIES], "'Other'")} AS category FROM g""")
def campaign_naming(spark, sf_dir):
    """Campaign name with its place, and category, by pattern (DM-13)."""
    places = F.array(*[F.lit(p) for p in ("Delhi", "jamtara", "Noida", "nowhere", "delhigate")])
    text = F.concat("text", F.lit(" in "), F.get(places, (F.col("author") % 5).cast("int")))
    low = F.lower(text)
    return claims(spark, sf_dir).select("id", T.campaign_name(text).alias("name"), T.first_match([(n, low.rlike(p)) for n, p in X.CAMPAIGN_CATEGORIES], "Other").alias("category"))


@query(f"""WITH p AS (SELECT c_custkey AS id, CAST(6000000000 + c_custkey * 1999993 % 3999999999 AS VARCHAR) AS n FROM customer)
  SELECT id, n, CASE WHEN substr(n, 1, 4) IN ({", ".join(f"'{x}'" for x in X.JIO_PREFIXES)}) OR substr(n, 1, 2) IN ({", ".join(f"'{x}'" for x in X.CARRIERS[0][1])}) THEN 'Jio'
    {" ".join("WHEN substr(n, 1, 2) IN (" + ", ".join(f"'{x}'" for x in s) + f") THEN '{c}'" for c, s in X.CARRIERS[1:])} ELSE 'Unknown' END AS carrier,
    CASE substr(n, 1, 2) {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.CIRCLES)} ELSE 'Unknown' END AS circle FROM p""")
def phone_lookup(spark, sf_dir):
    """Carrier and circle by prefix (SF-38)."""
    n = (F.lit(6_000_000_000) + (F.col("c_custkey") * 1_999_993) % 3_999_999_999).cast("string")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), n.alias("n"), T.carrier(n).alias("carrier"), T.circle(n).alias("circle"))


FREEZE_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.FREEZE_BANKS)
HANDLES = ["paytm", "ybl", "OKSBI", "kotak", "okaxis", "gpay", "ibl", "apl", "nobank"]


@query(f"""WITH p AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '+91 ' WHEN 1 THEN '91-' ELSE '' END || CASE WHEN c_custkey % 11 = 0 THEN '12345' ELSE CAST(2000000000 + c_custkey * 1999993 % 7999999999 AS VARCHAR) END AS phone FROM customer),
  b AS (SELECT id, phone, replace(replace(phone, ' ', ''), '-', '') AS bare FROM p), d AS (SELECT *, CASE WHEN bare LIKE '+91%' THEN substr(bare, 4) WHEN bare LIKE '91%' AND length(bare) > 10 THEN substr(bare, 3) ELSE bare END AS n FROM b),
  c AS (SELECT *, CASE WHEN length(n) <> 10 THEN 'Unknown' WHEN substr(n, 1, 4) IN ({", ".join(f"'{x}'" for x in X.JIO_PREFIXES)}) OR substr(n, 1, 2) IN ({", ".join(f"'{x}'" for x in X.CARRIERS[0][1])}) THEN 'Jio'
    {" ".join("WHEN substr(n, 1, 2) IN (" + ", ".join(f"'{x}'" for x in s) + f") THEN '{c}'" for c, s in X.CARRIERS[1:])} ELSE 'Unknown' END AS carrier,
    CASE WHEN length(n) <> 10 THEN 'Unknown' ELSE CASE substr(n, 1, 2) {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.CIRCLES)} ELSE 'Unknown' END END AS circle FROM d)
  SELECT id, phone, carrier, CASE carrier {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.OPERATORS)} ELSE 'Unknown' END AS operator, circle,
    CASE WHEN length(n) <> 10 THEN 'UNKNOWN' WHEN substr(n, 1, 1) IN ('6', '7', '8', '9') THEN 'MOBILE' ELSE 'LANDLINE' END AS number_type,
    CASE WHEN length(n) <> 10 THEN 'Invalid phone number format' WHEN circle IN ('Jharkhand', 'Bihar') THEN 'High-risk telecom circle: ' || circle || ' (Jamtara belt)' ELSE '' END AS risk FROM c""")
def phone_profiles(spark, sf_dir):
    """Carrier, operator, circle, type and risk of numbers as people write them (SF-38)."""
    k = F.col("c_custkey")
    start = F.when(k % 4 == 0, "+91 ").when(k % 4 == 1, "91-").otherwise("")
    digits = F.when(k % 11 == 0, "12345").otherwise((F.lit(2_000_000_000) + (k * 1_999_993) % 7_999_999_999).cast("string"))
    found = read(spark, sf_dir, "customer").select(k.alias("id"), F.concat(start, digits).alias("phone"))
    return found.select("id", "phone", T.phone_profile(F.col("phone")).alias("p")).select("id", "phone", "p.*")


@query(f"""WITH u AS (SELECT c_custkey AS id, 'p' || CAST(c_custkey AS VARCHAR) || '@' || ({sql_list(HANDLES)})[CAST(c_custkey % {len(HANDLES)} AS INTEGER) + 1] AS upi FROM customer),
  h AS (SELECT *, lower(split_part(upi, '@', 2)) AS handle FROM u) SELECT id, upi, CASE handle {FREEZE_SQL} ELSE 'Unknown (' || handle || ')' END AS bank FROM h""")
def freeze_bank_lookup(spark, sf_dir):
    """Bank of a payment address by the table of freeze requests (SF-39)."""
    upi = F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit("@"), F.get(F.array(*[F.lit(h) for h in HANDLES]), (F.col("c_custkey") % len(HANDLES)).cast("int")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), upi.alias("upi"), T.freeze_bank(upi).alias("bank"))


BANKS_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.UPI_BANKS)


@query(f"""WITH u AS (SELECT c_custkey AS id, 'p' || CAST(c_custkey AS VARCHAR) || '@' || (['paytm', 'ybl', 'OKSBI', 'kotak', 'okaxis', 'gpay'])[CAST(c_custkey % 6 AS INTEGER) + 1] AS upi FROM customer),
  h AS (SELECT *, lower(split_part(upi, '@', 2)) AS handle FROM u) SELECT id, upi, CASE handle {BANKS_SQL} ELSE 'Unknown (' || handle || ')' END AS bank FROM h""")
def upi_bank_lookup(spark, sf_dir):
    handles = F.array(*[F.lit(h) for h in ("paytm", "ybl", "OKSBI", "kotak", "okaxis", "gpay")])
    upi = F.concat(F.lit("p"), F.col("c_custkey").cast("string"), F.lit("@"), F.get(handles, (F.col("c_custkey") % 6).cast("int")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), upi.alias("upi"), T.upi_bank(upi).alias("bank"))


DOMAIN_SQL = "lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]+)', 1))"


@query(f"""WITH p AS (SELECT page_id, url, {DOMAIN_SQL} AS domain FROM pages)
  SELECT page_id, domain, array_to_string(list_filter([CASE WHEN domain IN ({", ".join(f"'{s}'" for s in X.SHORTENERS)}) THEN 'URL_SHORTENER' END,
    CASE WHEN {sql_any('url', X.URL_SCAM_WORDS)} THEN 'SCAM_KEYWORDS' END, CASE WHEN regexp_matches(domain, '({"|".join(t.replace(".", chr(92) + ".") for t in X.SUSPICIOUS_TLDS)})$') THEN 'SUSPICIOUS_TLD' END,
    CASE WHEN len(domain) - len(replace(domain, '.', '')) > 3 THEN 'EXCESSIVE_SUBDOMAINS' END], lambda x: x IS NOT NULL), ',') AS threats FROM p""")
def url_threats(spark, sf_dir):
    """Address heuristics (SF-35, SF-36)."""
    return read(spark, sf_dir, "pages").select("page_id", T.url_domain(F.col("url")).alias("domain"), _joined("threats", T.url_threats(F.col("url"))))


QRS = """qr AS (SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN 'upi://pay?pa=a' || o_custkey || '@ybl&am=' || (o_custkey % 3) * 50 WHEN 1 THEN 'https://wa.me/91' || (9000000000 + o_custkey)
    WHEN 2 THEN 'https://t.me/ch' || o_custkey WHEN 3 THEN 'tel:+91' || (9000000000 + o_custkey) WHEN 4 THEN 'http://x' || o_custkey || '.example.com/a' ELSE 'raw ' || o_custkey END AS v FROM orders)"""


@query(f"""WITH {QRS}, t AS (SELECT *, CASE WHEN starts_with(v, 'upi://') THEN 'UPI_PAYMENT' WHEN contains(v, 'wa.me/') THEN 'WHATSAPP' WHEN contains(v, 't.me/') THEN 'TELEGRAM'
    WHEN regexp_matches(v, '^tel:\\+?\\d+$') THEN 'PHONE' WHEN regexp_matches(v, '^https?://') THEN 'URL' ELSE 'UNKNOWN' END AS qr_type FROM qr)
  SELECT id, qr_type, round(CASE qr_type {" ".join(f"WHEN '{k}' THEN {r}" for k, r in X.QR_RISK)} ELSE 0.3 END
    + CASE WHEN qr_type = 'UPI_PAYMENT' AND TRY_CAST(regexp_extract(v, 'am=([0-9.]+)', 1) AS DOUBLE) > 0 THEN 0.15 ELSE 0 END, 2)::DOUBLE AS risk FROM t""")
def qr_classify(spark, sf_dir):
    """Payload type and risk of decoded codes (SF-25, SF-26, RM-16)."""
    key, k = F.col("o_custkey"), F.col("o_custkey").cast("string")
    v = (
        F.when(key % 6 == 0, F.concat(F.lit("upi://pay?pa=a"), k, F.lit("@ybl&am="), ((key % 3) * 50).cast("string")))
        .when(key % 6 == 1, F.concat(F.lit("https://wa.me/91"), (key + 9_000_000_000).cast("string")))
        .when(key % 6 == 2, F.concat(F.lit("https://t.me/ch"), k)).when(key % 6 == 3, F.concat(F.lit("tel:+91"), (key + 9_000_000_000).cast("string")))
        .when(key % 6 == 4, F.concat(F.lit("http://x"), k, F.lit(".example.com/a"))).otherwise(F.concat(F.lit("raw "), k))
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.qr_type(v).alias("qr_type"), T.qr_risk(v).alias("risk"))


@query("""SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN CAST(o_custkey / 10.0 AS BIGINT) * 1000 WHEN 1 THEN (o_custkey % 90) * 1000000 WHEN 2 THEN 1000000 + o_custkey ELSE 0 END AS n FROM orders""")
def parse_counts(spark, sf_dir):
    """Engagement counts such as 1.2K, 5M and 1,234 (SF-24)."""
    key = F.col("o_custkey")
    text = (
        F.when(key % 4 == 0, F.concat(F.round(key / 10.0, 0).cast("long").cast("string"), F.lit("K")))
        .when(key % 4 == 1, F.concat((key % 90).cast("string"), F.lit("m")))
        .when(key % 4 == 2, F.format_number(key + 1_000_000, 0)).otherwise("n/a")
    )
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.parse_count(text).alias("n"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS stable_id, substr(sha256(substr(text, 1, 200)), 1, 8) AS content_key, length(text) AS n_chars FROM documents")
def stable_ids(spark, sf_dir):
    """Identifiers from content (SF-27, SF-47)."""
    return _docs(spark, sf_dir).select(
        "doc_id", T.stable_id(F.col("text")).alias("stable_id"), T.stable_id(F.substring("text", 1, 200), 8).alias("content_key"), F.length("text").cast("long").alias("n_chars")
    )


@query(f"""WITH {ENTITIES}, v AS (SELECT channel, count(*) AS victims FROM entities GROUP BY 1)
  SELECT channel, victims, CASE WHEN victims * 25000 >= 10000000 THEN '₹' || printf('%.1f', round(victims * 25000 / 10000000.0::DOUBLE, 1)) || ' Crore'
    WHEN victims * 25000 >= 100000 THEN '₹' || printf('%.1f', round(victims * 25000 / 100000.0::DOUBLE, 1)) || ' Lakh' ELSE '₹' || CAST(victims * 25000 AS VARCHAR) END AS loss FROM v""")
def loss_estimates(spark, sf_dir):
    """Loss in words by the number of victims (SF-42, DM-23)."""
    v = entities(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("victims"))
    return v.select("channel", "victims", T.loss_text(F.col("victims")).alias("loss"))


@query()
def promises_extract(spark, sf_dir):
    """Investment promises of the claims (SF-13); rows only, tests hold the values."""
    return claims(spark, sf_dir).select("id", F.explode(T.promises(F.col("text"))).alias("p")).select("id", "p.text", "p.promise_type", "p.language")


@query()
def word_phones(spark, sf_dir):
    """Numbers written as words after a trigger (SF-4), by an Arrow UDF."""
    from vigilspark.functions.udfs import word_form_phones

    digits = ["zero", "ek", "two", "teen", "four", "panch", "six", "saat", "eight", "nine"]
    words = F.array(*[F.lit(d) for d in digits])
    spoken = F.array_join(F.transform(F.split((F.col("c_custkey") + 9_000_000_000).cast("string"), ""), lambda d: F.get(words, d.try_cast("int"))), " ")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("please call "), spoken, F.lit(" today")).alias("text"))
    return rows.select("id", F.explode(word_form_phones("text")).alias("phone"))


@query()
def cleaned_texts(spark, sf_dir):
    """Texts after the recognition fixes (SF-22); lookaround keeps it from the oracle's dialect."""
    return _docs(spark, sf_dir).select("doc_id", T.stable_id(T.clean_text(F.col("text"))).alias("cleaned_id"))


@query()
def parsed_entities(spark, sf_dir):
    """All entity arrays of each text in one struct (SF-14)."""
    return channel_texts(spark, sf_dir).select("message_id", T.parse_entities(F.col("text")).alias("e")).select("message_id", "e.*")
