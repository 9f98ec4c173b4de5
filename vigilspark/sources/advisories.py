"""Readers of advisory and alert texts: parsed documents with minimum lengths and caps, and their entities (SC-18, SC-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import text as T

#: Characters that a text needs, of the title and of the content that is kept.
ADVISORY = {"least": 30, "title": 150}
ALERT = {"least": 20, "title": 200}
CONTENT = 3_000


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _foreign(domains: Column, own: list[str]) -> Column:
    """Domains that hold none of the publisher's own."""
    for name in own:
        domains = _without(domains, name)
    return domains


def _without(domains: Column, name: str) -> Column:
    return F.filter(domains, lambda d: ~d.contains(name))


def _stripped(texts: DataFrame, least: int) -> DataFrame:
    """Texts without white space at the ends, those that are long enough; null texts go."""
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    return texts.withColumn("text", bare).where(F.length("text") >= least)


def _number() -> Column:
    """The index with at least four digits; ``lpad`` alone would cut longer ones."""
    digits = F.col("idx").cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))


def _title(text: Column, length: int) -> Column:
    return F.substring(F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), r"^\s+|\s+$", ""), 1, length)


def advisories(texts: DataFrame) -> DataFrame:
    """Advisories from text blocks (source_url, idx, text), one row for each of at least 30 characters (SC-18).

    Addresses and foreign domains in order of occurrence with repeats, 50 of each, all
    linked channels, violation, the first five legal citations.
    """
    t = F.col("text")
    return _stripped(texts, ADVISORY["least"]).select(
        F.concat(F.lit("I4C-ADV-"), _number()).alias("advisory_id"), "source_url", _title(t, ADVISORY["title"]).alias("title"), F.substring(t, 1, CONTENT).alias("content"),
        F.slice(_all(t, X.ADVISORY_URL), 1, 50).alias("blocked_urls"), F.slice(_foreign(_all(t, X.ADVISORY_DOMAIN), X.ADVISORY_OWN), 1, 50).alias("blocked_domains"),
        F.transform(_all(t, X.ADVISORY_CHANNEL), lambda c: F.regexp_replace(c, r"^https?://t\.me/", "")).alias("blocked_channels"),
        T.violation_type(t).alias("violation_type"), F.array_join(F.slice(_all(t, X.LEGAL_CITATION), 1, 5), "; ").alias("it_act_section"),
    )


def advisory_entities(parsed: DataFrame) -> DataFrame:
    """(entity_value, entity_type, reason, advisory_source, it_act_section): a confirmed entry for each address, domain and channel of :func:`advisories`."""
    typed = [_typed("blocked_urls", "URL"), _typed("blocked_domains", "DOMAIN"), _typed("blocked_channels", "CHANNEL")]
    rows = parsed.select(F.explode(F.concat(*typed)).alias("e"), "violation_type", "advisory_id", "it_act_section")
    return rows.select("e.entity_value", "e.entity_type", F.col("violation_type").alias("reason"), F.col("advisory_id").alias("advisory_source"), "it_act_section")


def _typed(column: str, kind: str) -> Column:
    return F.transform(column, lambda v: F.struct(v.alias("entity_value"), F.lit(kind).alias("entity_type")))


def alerts(texts: DataFrame) -> DataFrame:
    """Alerts from text blocks (source_url, idx, text), one row for each of at least 20 characters (SC-19).

    Distinct indicators in sorted order: 50 foreign domains, 50 addresses of machines, 20
    payment addresses, 10 vulnerabilities; ``infrastructure`` names 20 domains, 20 machines
    and 10 addresses, 50 in all.
    """
    t = F.col("text")
    known = lambda pattern: F.array_sort(F.array_distinct(_all(t, pattern)))
    marked = lambda c, k, n: F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit(k), x))
    domains, ips, urls = _foreign(known(X.IOC_DOMAIN), X.ALERT_OWN), known(X.IOC_IP), known(X.ADVISORY_URL)
    return _stripped(texts, ALERT["least"]).select(
        F.concat(F.lit("CERTIN-"), _number()).alias("alert_id"), "source_url", _title(t, ALERT["title"]).alias("title"), F.substring(t, 1, CONTENT).alias("content"),
        T.severity(t).alias("severity"), F.slice(domains, 1, 50).alias("domains"), F.slice(ips, 1, 50).alias("ips"), F.slice(known(X.ALERT_UPI), 1, 20).alias("upis"), F.slice(known(X.IOC_CVE), 1, 10).alias("cves"),
        F.slice(F.concat(marked(domains, "domain:", 20), marked(ips, "ip:", 20), marked(urls, "url:", 10)), 1, 50).alias("infrastructure"),
    )
