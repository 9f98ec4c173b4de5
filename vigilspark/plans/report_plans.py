"""Queries that assemble texts, read advisories and enrich entities of collected posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import reports as R
from vigilspark.functions import text as T
from vigilspark.operators import decision as D
from vigilspark.plans.decision_plans import COLLECTED, TOLD, told
from vigilspark.plans.testbed import read, sql_any
from vigilspark.plans.text_plans import BANKS_SQL, DOMAIN_SQL, KEYWORDS, TEN, UPI_SQL, URL_SQL, _re, keyword_rows, taxonomy
from vigilspark.sources import advisories as A

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _kept(parts: list[str]) -> str:
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


def _keyword_sql(english, hindi) -> str:
    e = _kept([f"CASE WHEN contains(lower(text), {_quoted(w.lower())}) THEN {_quoted(f"Contains '{w}' (English keyword match)")} END" for w in english])
    h = _kept([f"CASE WHEN contains(text, {_quoted(w)}) THEN {_quoted(f"Contains '{w}' (Hindi keyword match)")} END" for w in hindi])
    return f"list_concat(({e})[1:5], {h})[1:8]"


def _lookup(column: str, pick) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{c[0]}' THEN {_quoted(str(pick(c)))}" for c in X.CATEGORIES) + " ELSE '' END"


_URLS = URL_SQL.replace("html || ' ' || url", "text")
CLASSIFIED = f"""{TOLD}, {KEYWORDS}, s AS (SELECT message_id, category, position, sum(weight) AS s FROM told JOIN keywords ON contains(lower(text), keyword) GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY s DESC, position) AS n FROM s),
  cl AS (SELECT t.message_id, t.text, coalesce(a.category, 'unknown') AS category, {_lookup("CASE WHEN b.s > a.s * 0.3 THEN b.category END", lambda c: c[1])} AS secondary,
    len(list_distinct({TEN.replace('text', 't.text')})) AS phones, len(list_distinct({UPI_SQL.replace('text', 't.text')})) AS upis
    FROM told t LEFT JOIN r a ON a.message_id = t.message_id AND a.n = 1 LEFT JOIN r b ON b.message_id = t.message_id AND b.n = 2),
  ind AS (SELECT *, CASE category {" ".join(f"WHEN '{c[0]}' THEN list_concat({_keyword_sql(c[6], c[7])}, {_kept([f'CASE WHEN regexp_matches(text, {_re(p)}) THEN {_quoted(t)} END' for p, t in X.GENERAL_INDICATORS])})[1:10]" for c in X.CATEGORIES)} ELSE [] END AS found FROM cl)"""


@query(f"""WITH {CLASSIFIED} SELECT message_id AS id, category, len(found) AS n_indicators, CASE WHEN category = 'unknown' THEN 'Unable to classify content.' ELSE concat_ws(chr(10),
    'This content has been classified as **' || {_lookup('category', lambda c: c[1])} || '** under the ' || {_lookup('category', lambda c: c[2].replace('_', ' '))} || ' category.',
    CASE WHEN len(found) > 0 THEN chr(10) || chr(10) || 'Key indicators found (' || len(found) || '):' || chr(10) || array_to_string(list_transform(found[1:5], lambda x: '  • ' || x), chr(10)) END,
    CASE WHEN secondary <> '' THEN chr(10) || chr(10) || 'Also related to: ' || secondary END, chr(10) || chr(10) || 'Applicable law: ' || {_lookup('category', lambda c: c[5])}, 'Severity: ' || {_lookup('category', lambda c: c[3])},
    'Blocking priority: ' || {_lookup('category', lambda c: c[4])} || '/5', CASE WHEN phones > 0 OR upis > 0 THEN chr(10) || chr(10) || 'Entities detected: ' || phones || ' phone(s), ' || upis || ' UPI ID(s)' END) END AS explanation FROM ind""")
def text_explanations(spark, sf_dir):
    """Classified posts with an explanation for an officer (DM-17, RM-9): one pass, nothing is shuffled but the posts' addresses."""
    posts = told(spark, sf_dir).select("message_id", "text")
    found = taxonomy(posts.select(F.struct("message_id", "text").alias("id"), "text"), keyword_rows()).select("id.message_id", "id.text", "category", "secondary")
    t = F.col("text")
    found = found.withColumns({"found": R.keyword_indicators(t, F.col("category")), "phones": F.size(T.phones(t)), "upis": F.size(T.upis(t))})
    told_so = R.explanation(F.col("category"), F.col("found"), R.category_label(F.col("secondary")), F.col("phones"), F.col("upis"))
    return found.select(F.col("message_id").alias("id"), "category", F.size("found").alias("n_indicators"), told_so.alias("explanation"))


@query(f"""WITH {TOLD}, c AS (SELECT message_id AS id, len(list_distinct({TEN})) AS p, len(list_distinct({UPI_SQL})) AS u, len(list_distinct({_URLS})) AS w FROM told)
  SELECT id, array_to_string({_kept(["CASE WHEN p > 0 THEN 'Phone numbers detected: ' || p END", "CASE WHEN u > 0 THEN 'UPI IDs detected: ' || u END", "CASE WHEN w > 0 THEN 'Suspicious URLs detected: ' || w END"])}, '; ') AS indicators FROM c""")
def post_indicators(spark, sf_dir):
    """Indicators of posts from the counts of their parsed entities (RM-8)."""
    t = F.col("text")
    counts = [F.size(x) for x in (T.phones(t), T.upis(t), T.urls(t))]
    return told(spark, sf_dir).select(F.col("message_id").alias("id"), F.array_join(T.indicators(*counts), "; ").alias("indicators"))


def _typed_sql(kind: str, pattern: str, more: str = "") -> str:
    found = f"regexp_extract_all(text, {_re(pattern)})"
    return f"list_transform({f'list_filter({found}, lambda x: {more})' if more else found}, lambda x: '{kind}:' || trim(x))"


@query(f"""WITH {TOLD} SELECT message_id AS id, array_to_string(list_sort(list_distinct(flatten([{_typed_sql('PHONE', '(?:[+]91[-' + chr(92) + 's]?)?[6-9]' + chr(92) + 'd{9}')},
    {_typed_sql('UPI', '[a-zA-Z0-9._-]+@[a-zA-Z]{2,10}', "NOT regexp_matches(x, '[.](com|in|org|gov|net)$')")}, {_typed_sql('URL', X.ADVISORY_URL)}, {_typed_sql('TELEGRAM', 't[.]me/[a-zA-Z0-9_]+')}, {_typed_sql('SOCIAL', '@[a-zA-Z0-9_.]{3,30}')}]))), ' ') AS entities FROM told""")
def complaint_extract(spark, sf_dir):
    """All five types of entities of complaints (SF-16)."""
    return told(spark, sf_dir).select(F.col("message_id").alias("id"), F.array_join(F.array_sort(T.complaint_entities(F.col("text"))), " ").alias("entities"))


PAID = "paid AS (SELECT o_orderkey AS id, 'bank transfer ' || (100000000 + o_orderkey * 7919 % 800000000) || ' or ' || (30000000000 + o_custkey * 104729) || CASE WHEN o_orderkey % 3 = 0 THEN ', not 6' || (100000000 + o_custkey) ELSE '' END AS text FROM orders)"


@query(f"""WITH {PAID} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, {_re(X.BANK_ACCOUNT)}, 1), lambda x: NOT regexp_matches(right(x, 10), '^[6-9]')))), ',') AS accounts FROM paid""")
def transfer_accounts(spark, sf_dir):
    """Account numbers of texts on transfers; numbers whose tenth digit from the end is 6 to 9 look like phones (SF-10)."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    also = F.when(key % 3 == 0, F.concat(F.lit(", not 6"), (cust + 100_000_000).cast("string"))).otherwise("")
    text = F.concat(F.lit("bank transfer "), (key * 7_919 % 800_000_000 + 100_000_000).cast("string"), F.lit(" or "), (cust * 104_729 + 30_000_000_000).cast("string"), also)
    return read(spark, sf_dir, "orders").select(key.alias("id"), F.array_join(T.bank_accounts(text), ",").alias("accounts"))


_CARRIER = (
    f"CASE WHEN substr(n, 1, 4) IN ({', '.join(map(_quoted, X.JIO_PREFIXES))}) OR substr(n, 1, 2) IN ({', '.join(map(_quoted, X.CARRIERS[0][1]))}) THEN 'Jio' "
    + " ".join(f"WHEN substr(n, 1, 2) IN ({', '.join(map(_quoted, s))}) THEN '{c}'" for c, s in X.CARRIERS[1:]) + " ELSE 'Unknown' END"
)
_THREATS = _kept([
    f"CASE WHEN domain IN ({', '.join(map(_quoted, X.SHORTENERS))}) THEN 'URL_SHORTENER' END", f"CASE WHEN {sql_any('value', X.URL_SCAM_WORDS)} THEN 'SCAM_KEYWORDS' END",
    f"CASE WHEN regexp_matches(domain, '({'|'.join(t.replace('.', '[.]') for t in X.SUSPICIOUS_TLDS)})$') THEN 'SUSPICIOUS_TLD' END", "CASE WHEN len(domain) - len(replace(domain, '.', '')) > 3 THEN 'EXCESSIVE_SUBDOMAINS' END",
])


@query(f"""WITH {COLLECTED}, v AS (SELECT *, replace(replace(CASE WHEN value LIKE '+91%' THEN substr(value, 4) ELSE value END, ' ', ''), '-', '') AS n, lower(split_part(value, '@', 2)) AS handle, {DOMAIN_SQL.replace('url', 'value')} AS domain FROM collected),
  p AS (SELECT *, CASE WHEN length(n) <> 10 THEN 'Unknown' ELSE {_CARRIER} END AS carrier, CASE WHEN length(n) <> 10 THEN 'Unknown' ELSE CASE substr(n, 1, 2) {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.CIRCLES)} ELSE 'Unknown' END END AS circle FROM v)
  SELECT channel, entity_type, value, CASE entity_type WHEN 'PHONE' THEN carrier || ', ' || circle WHEN 'UPI' THEN CASE handle {BANKS_SQL} ELSE 'Unknown (' || handle || ')' END
    WHEN 'URL' THEN domain || ': ' || array_to_string({_THREATS}, ',') ELSE 'not_available' END AS enrichment FROM p""")
def collected_enrichment(spark, sf_dir):
    """What is known of each entity of the posts by its type (SF-40): carrier and circle, bank, domain and threats."""
    v = F.col("value")
    phone = T.phone_profile(v)
    found = (
        F.when(F.col("entity_type") == "PHONE", F.concat_ws(", ", phone["carrier"], phone["circle"])).when(F.col("entity_type") == "UPI", T.upi_bank(v))
        .when(F.col("entity_type") == "URL", F.concat(T.url_domain(v), F.lit(": "), F.array_join(T.url_threats(v), ","))).otherwise("not_available")
    )
    return D.collected(told(spark, sf_dir)).select("channel", "entity_type", "value", found.alias("enrichment"))


NOTICED = f"""{TOLD}, noticed AS (SELECT message_id AS idx, trim(text || CASE WHEN message_id % 4 = 1 THEN ' IT Act Section 66D, information technology act § 69A/79' WHEN message_id % 4 = 2 THEN ' from 10.0.' || message_id % 256 || '.7 and cyber.cert-in.org, CVE-2024-' || (1000 + message_id) ELSE '' END) AS text FROM told)"""


def noticed(spark, sf_dir):
    """Posts as blocks of an advisory page, with citations, machines and vulnerabilities."""
    k = F.col("message_id")
    more = (
        F.when(k % 4 == 1, " IT Act Section 66D, information technology act § 69A/79")
        .when(k % 4 == 2, F.concat(F.lit(" from 10.0."), (k % 256).cast("string"), F.lit(".7 and cyber.cert-in.org, CVE-2024-"), (k + 1000).cast("string"))).otherwise("")
    )
    return told(spark, sf_dir).select(F.lit("page").alias("source_url"), k.alias("idx"), F.concat("text", more).alias("text"))


def _foreign_sql(pattern: str, own: list[str]) -> str:
    return f"list_filter(regexp_extract_all(text, {_re(pattern)}), lambda x: NOT ({' OR '.join(f'contains(x, {_quoted(o)})' for o in own)}))"


_ID = "lpad(CAST(idx AS VARCHAR), greatest(length(CAST(idx AS VARCHAR)), 4)::INTEGER, '0')"


@query(f"""WITH {NOTICED}, typed AS (SELECT 'I4C-ADV-' || {_ID} AS advisory_source, CASE {" ".join(f"WHEN {sql_any('text', w)} THEN '{k}'" for k, w in X.VIOLATIONS)} ELSE 'OTHER' END AS reason,
    array_to_string(regexp_extract_all(text, {_re(X.LEGAL_CITATION)})[1:5], '; ') AS it_act_section, list_concat(list_concat(list_transform(regexp_extract_all(text, {_re(X.ADVISORY_URL)})[1:50], lambda x: {{'v': x, 't': 'URL'}}),
    list_transform(({_foreign_sql(X.ADVISORY_DOMAIN, X.ADVISORY_OWN)})[1:50], lambda x: {{'v': x, 't': 'DOMAIN'}})), list_transform(regexp_extract_all(text, {_re(X.ADVISORY_CHANNEL)}), lambda x: {{'v': regexp_replace(x, '^https?://t[.]me/', ''), 't': 'CHANNEL'}})) AS e
    FROM noticed WHERE length(text) >= 30), flat AS (SELECT unnest(e) AS e, reason, advisory_source, it_act_section FROM typed) SELECT e.v AS entity_value, e.t AS entity_type, reason, advisory_source, it_act_section FROM flat""")
def advisory_entities(spark, sf_dir):
    """Confirmed entries of advisories read from text blocks (SC-18)."""
    return A.advisory_entities(A.advisories(noticed(spark, sf_dir)))


@query(f"""WITH {NOTICED}, f AS (SELECT *, list_sort(list_distinct({_foreign_sql(X.IOC_DOMAIN, X.ALERT_OWN)})) AS d, list_sort(list_distinct(regexp_extract_all(text, {_re(X.IOC_IP)}))) AS i, list_sort(list_distinct(regexp_extract_all(text, {_re(X.ALERT_UPI)}))) AS u,
    list_sort(list_distinct(regexp_extract_all(text, {_re(X.IOC_CVE)}))) AS c, list_sort(list_distinct(regexp_extract_all(text, {_re(X.ADVISORY_URL)}))) AS w FROM noticed WHERE length(text) >= 20)
  SELECT 'CERTIN-' || {_ID} AS alert_id, substr(split_part(text, chr(10), 1), 1, 200) AS title, CASE {" ".join(f"WHEN {sql_any('text', w)} THEN '{k}'" for k, w in X.SEVERITY_WORDS)} ELSE 'MEDIUM' END AS severity, array_to_string(d[1:50], ',') AS domains,
    array_to_string(i[1:50], ',') AS ips, array_to_string(u[1:20], ',') AS upis, array_to_string(c[1:10], ',') AS cves,
    array_to_string(list_concat(list_concat(list_transform(d[1:20], lambda x: 'domain:' || x), list_transform(i[1:20], lambda x: 'ip:' || x)), list_transform(w[1:10], lambda x: 'url:' || x))[1:50], ' ') AS infrastructure FROM f""")
def alert_documents(spark, sf_dir):
    """Alerts read from text blocks with their indicators (SC-19)."""
    lists = [F.array_join(c, s).alias(c) for c, s in (("domains", ","), ("ips", ","), ("upis", ","), ("cves", ","), ("infrastructure", " "))]
    return A.alerts(noticed(spark, sf_dir)).select("alert_id", "title", "severity", *lists)
