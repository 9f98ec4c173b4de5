"""Entity extraction, cleaning and classification of text as column expressions (SF-1..26, SF-35..53).

All functions take and return columns and stay in generated code; null text
gives empty arrays.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions.words import word_numbers


def _all(text: Column, pattern: str, group: int = 0, needs: str = "") -> Column:
    """All matches; ``needs`` is a string that every match holds, and a text without it is not searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.coalesce(F.when(text.contains(needs), found) if needs else found, F.array().cast("array<string>"))


def _sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def any_word(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains any of the words as a plain substring (PR-14); null text has none."""
    low = F.lower(text)  # plain searches, which end at the first hit, cost far less than one long alternation
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(False))


def needed_literal(pattern: str) -> str:
    """The longest run of letters or ``%`` that every match of a simple pattern holds, "" if none is certain.

    Groups, optional characters and classes are cut out first; a pattern with a top-level
    choice, a class or an escape other than ``\\b \\s \\d`` gives none.
    """
    flat = re.sub(r"\(\?:[^()]*\)\??", " ", pattern)
    flat = re.sub(r"\\[bsd][+*?]?", " ", flat)
    flat = re.sub(r".[?*]|.\{", " ", flat)
    if re.search(r"[|\[\](){}\\+^$.]", flat):
        return ""
    return max(re.findall(r"[a-z%]+", flat), key=len, default="")


def matches(low: Column, pattern: str) -> Column:
    """``rlike`` on a lower-cased text, tried only where the literal that the pattern needs occurs."""
    literal = needed_literal(pattern)
    return low.contains(literal) & low.rlike(pattern) if literal else low.rlike(pattern)


def word_hits(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the lower-cased text."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.coalesce(low.contains(w).cast("int"), F.lit(0)) for w in words])


def first_match(pairs: list[tuple[str, Column]], default: str | None) -> Column:
    """The label of the first condition that holds."""
    out = F.when(pairs[0][1], F.lit(pairs[0][0]))
    for label, condition in pairs[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(default))


def last_ten(value: Column) -> Column:
    return F.right(F.regexp_replace(value, "[^0-9]", ""), F.lit(10))


def phones(text: Column) -> Column:
    """Standard mobile numbers as their last ten digits, sorted and distinct (SF-1)."""
    ten = F.transform(_all(text, X.PHONE), lambda x: last_ten(x))
    return _sorted_set(F.filter(ten, lambda x: x.rlike("^[6-9]")))


def normalised_phone(raw: Column) -> Column:
    """``+91-XXXXXXXXXX``, or an empty string."""
    ten = last_ten(raw)
    return F.when(ten.rlike("^[6-9][0-9]{9}$"), F.concat(F.lit("+91-"), ten)).otherwise(F.lit(""))


def disguised_phones(text: Column) -> Column:
    """Numbers with letters for digits: O, I and L become 0, 1 and 1 (SF-3)."""
    ten = F.transform(_all(text, X.PHONE_DISGUISED), lambda x: last_ten(F.translate(F.upper(x), "OIL", "011")))
    return _sorted_set(F.filter(ten, lambda x: x.rlike("^[6-9][0-9]{9}$")))


def whatsapp_phones(text: Column) -> Column:
    return _sorted_set(F.filter(_all(text, X.PHONE_WHATSAPP, 1, "/"), lambda x: x.rlike("^[6-9]")))


def upis(text: Column) -> Column:
    """Payment addresses without mail providers, handles of at most ten letters (SF-6)."""
    found = F.transform(_all(text, X.UPI, needs="@"), lambda x: F.lower(x))
    keep = F.filter(found, lambda x: (~x.rlike("|".join(X.MAIL_PROVIDERS))) & (F.length(F.split_part(x, F.lit("@"), F.lit(2))) <= 10))
    return _sorted_set(keep)


def urls(text: Column) -> Column:
    """Links and short links, punctuation stripped at both ends, longer than eight characters (SF-7)."""
    bare = F.transform(_all(text, X.URL, needs="/"), lambda x: F.regexp_replace(x, "^[.,;:!?)\\]}>\"']+|[.,;:!?)\\]}>\"']+$", ""))
    return _sorted_set(F.filter(bare, lambda x: F.length(x) > 8))


def telegram_links(text: Column) -> Column:
    links = F.transform(_all(text, X.TELEGRAM_LINK, 1, "/"), lambda x: F.concat(F.lit("t.me/"), x))
    names = F.filter(_all(text, X.TELEGRAM_MENTION, 1, "@"), lambda x: ~F.lower(x).isin("gmail", "yahoo", "hotmail", "email"))
    return _sorted_set(F.concat(links, F.transform(names, lambda x: F.concat(F.lit("@"), x))))


def whatsapp_groups(text: Column) -> Column:
    return _sorted_set(F.transform(_all(text, X.WHATSAPP_GROUP, 1, "/"), lambda x: F.concat(F.lit("chat.whatsapp.com/"), x)))


def bank_accounts(text: Column) -> Column:
    """Numbers of 9 to 18 digits whose tenth digit from the end is not 6-9, where a banking word occurs (SF-10)."""
    found = F.filter(_all(text, X.BANK_ACCOUNT, 1), lambda x: ~F.right(x, F.lit(10)).rlike("^[6-9]"))
    return F.when(text.rlike("[0-9]{9}") & text.rlike(X.BANK_WORDS), _sorted_set(found)).otherwise(F.array().cast("array<string>"))


def ifsc_codes(text: Column) -> Column:
    return _sorted_set(_all(text, X.IFSC, needs="0"))


def amounts(text: Column) -> Column:
    """Positive rupee amounts as ``₹n`` without separators (SF-12)."""
    found = F.transform(_all(text, X.AMOUNT), lambda x: F.regexp_replace(F.regexp_extract(x, r"\d[\d,]*(?:\.\d{1,2})?", 0), ",", ""))
    return _sorted_set(F.transform(F.filter(found, lambda x: x.try_cast("double") > 0), lambda x: F.concat(F.lit("₹"), x)))


def promises(text: Column) -> Column:
    """Investment promises as (text, type, language), the first pattern that finds a text names it (SF-13)."""

    def found(kind: str, language: str, pattern: str) -> Column:
        def promise(x: Column) -> Column:
            return F.struct(F.trim(x).alias("text"), F.lit(kind).alias("promise_type"), F.lit(language).alias("language"))

        return F.transform(_all(text, "(?i)" + pattern), promise)

    every = F.concat(*[found(*p) for p in X.PROMISES])
    seen = F.transform(every, lambda p: p["text"])
    return F.filter(every, lambda p, i: F.array_position(seen, p["text"]) == i + 1)


def parse_entities(text: Column) -> Column:
    """Everything above in one struct (SF-14)."""
    return F.struct(
        phones(text).alias("phones"), upis(text).alias("upis"), urls(text).alias("urls"), bank_accounts(text).alias("bank_accounts"),
        ifsc_codes(text).alias("ifsc_codes"), amounts(text).alias("amounts"), telegram_links(text).alias("telegram_links"),
        whatsapp_groups(text).alias("whatsapp_groups"), promises(text).alias("promises"), disguised_phones(text).alias("disguised_phones"),
        whatsapp_phones(text).alias("whatsapp_phones"),
    )


def collected_entities(text: Column) -> Column:
    """Typed entities of a post as the collector reads them, distinct (SF-15): array of (entity_type, value); null text has none.

    Phones may be split five and five, payment addresses need one of the known
    handles, addresses may begin with www, links are to channels or mentions.
    Mentions of payment codes are those of :func:`shows_code`.
    """
    found = [
        ("PHONE", _all(text, X.COLLECTED_PHONE)), ("UPI", _all(text, X.COLLECTED_UPI, needs="@")),
        ("URL", _all(text, X.COLLECTED_URL)), ("TELEGRAM", _all(text, X.COLLECTED_LINK)),
    ]

    def typed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("entity_type"), x.alias("value")))

    return F.array_distinct(F.concat(*[typed(k, v) for k, v in found]))


def shows_code(text: Column) -> Column:
    """Whether a text mentions a payment code to scan; null text does not."""
    return F.coalesce(_may_show_code(text) & text.rlike(X.QR_MENTION), F.lit(False))


def code_mentions(text: Column) -> Column:
    """How many mentions of payment codes a text holds (DM-16); null text has null."""
    return F.when(_may_show_code(text), F.regexp_count(text, F.lit(X.QR_MENTION))).when(text.isNotNull(), F.lit(0))


def _may_show_code(text: Column) -> Column:
    """Whether the text holds a literal that every mention of a payment code needs."""
    low = F.lower(text)
    return low.contains("qr") | low.contains("scan")


def emoji_runs(text: Column, emoji: str) -> Column:
    """How many matches of ``emoji`` (beyond ASCII) a text holds: a text with as many bytes as characters has none."""
    return F.when(F.octet_length(text) > F.length(text), F.regexp_count(text, F.lit(emoji))).when(text.isNotNull(), F.lit(0))


def linked_name(link: Column) -> Column:
    """Channel that a collected link names: without mark and address, up to the first slash; a link without scheme names its host."""
    return F.split_part(F.regexp_replace(link, "^@+|https?://t\\.me/", ""), F.lit("/"), F.lit(1))


def complaint_entities(text: Column) -> Column:
    """Typed entities of a complaint in order of type and occurrence, distinct (SF-16)."""
    upi = F.filter(_all(text, r"[a-zA-Z0-9._-]+@[a-zA-Z]{2,10}", needs="@"), lambda x: ~x.rlike(r"\.(com|in|org|gov|net)$"))
    parts = [
        ("PHONE", _all(text, r"(?:\+91[-\s]?)?[6-9]\d{9}")), ("UPI", upi), ("URL", _all(text, r"https?://[^\s<>\"']+")),
        ("TELEGRAM", _all(text, r"t\.me/[a-zA-Z0-9_]+")), ("SOCIAL", _all(text, r"@[a-zA-Z0-9_.]{3,30}")),
    ]

    def typed(kind: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.concat(F.lit(kind + ":"), F.trim(x)))

    return F.array_distinct(F.concat(*[typed(k, v) for k, v in parts]))


def iocs(text: Column, kind: str) -> Column:
    """Indicators of an alert: DOMAIN, IP, CVE, URL or CITATION (SF-17)."""
    pattern = {"DOMAIN": X.IOC_DOMAIN, "IP": X.IOC_IP, "CVE": X.IOC_CVE, "URL": r"https?://[^\s<>\"']+", "CITATION": X.LEGAL_CITATION}[kind]
    return _sorted_set(_all(text, pattern))


def violation_type(text: Column) -> Column:
    return first_match([(k, any_word(text, words)) for k, words in X.VIOLATIONS], "OTHER")


def severity(text: Column) -> Column:
    return first_match([(k, any_word(text, words)) for k, words in X.SEVERITY_WORDS], "MEDIUM")


def mask_pii(text: Column) -> Column:
    """Masks in their fixed order; the payment rule fires before the mail rule (SF-19)."""
    return reduce(lambda c, m: F.regexp_replace(c, m[0], m[1]), X.MASKS, text)


def encrypt_pii(text: Column, key: Column) -> Column:
    """AES-256-GCM with the ``ENC:`` mark (SF-20); encrypted and empty values stay as they are."""
    done = text.startswith("ENC:") | (text == "")
    return F.when(done, text).otherwise(F.concat(F.lit("ENC:"), F.base64(F.aes_encrypt(text, key, F.lit("GCM")))))


def decrypt_pii(text: Column, key: Column) -> Column:
    clear = F.aes_decrypt(F.unbase64(F.substr(text, F.lit(5))), key, F.lit("GCM")).cast("string")
    return F.when(text.startswith("ENC:"), clear).otherwise(text)


def script_share(text: Column) -> Column:
    """Devanagari letters over Devanagari and Latin letters; null without any."""
    # lengths before and after whole runs are removed: far fewer matches than letters
    removed = lambda runs: F.length(text) - F.length(F.regexp_replace(text, runs, ""))
    deva, latin = removed("[ऀ-ॿ]+"), removed("[A-Za-z]+")
    # without a Devanagari letter the share is 0 if there is any Latin one, and letters need not be counted
    return F.when(text.rlike("[ऀ-ॿ]"), deva / F.nullif(deva + latin, F.lit(0))).when(text.rlike("[A-Za-z]"), F.lit(0.0))


def script_language(text: Column, mixed: float = 0.2, hindi: float = 0.6, empty: str = "unknown") -> Column:
    share = script_share(text)
    return F.when(share.isNull(), F.lit(empty)).when(share > hindi, F.lit("hindi")).when(share > mixed, F.lit("hinglish")).otherwise(F.lit("english"))


def clean_text(text: Column) -> Column:
    """Recognition fixes in order: vowel signs, digits, Hindi words, Latin pairs inside plain words, white space (SF-22, without NFC)."""
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), X.DEVANAGARI_FIXES, text)
    out = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), X.DIGIT_FIXES, out)
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), X.HINDI_WORD_FIXES, out)
    words = F.filter(F.split(out, r"\s+"), lambda w: w != "")

    def latin(word: Column) -> Column:
        fixed = reduce(lambda c, p: F.regexp_replace(c, f"(?<=[a-zA-Z]){p[0]}(?=[a-zA-Z])", p[1]), X.LATIN_FIXES, word)
        return F.when(word.rlike("[@:/.]"), word).otherwise(fixed)

    return F.array_join(F.transform(words, latin), " ")


def parse_count(text: Column) -> Column:
    """``1.2K``, ``5M``, ``1,234`` as a number, else 0 (SF-24)."""
    bare = F.upper(F.trim(F.replace(text, F.lit(","), F.lit(""))))
    body = F.regexp_replace(bare, "[KM]$", "").try_cast("double")
    scale = F.when(bare.endswith("K"), 1_000).when(bare.endswith("M"), 1_000_000).otherwise(1)
    return F.coalesce((body * scale).cast("long"), F.lit(0).cast("long"))


def qr_type(value: Column) -> Column:
    v = F.trim(value)
    return first_match(
        [
            ("UPI_PAYMENT", v.startswith("upi://")), ("WHATSAPP", v.contains("wa.me/") | v.contains("api.whatsapp.com")),
            ("TELEGRAM", v.contains("t.me/") | v.contains("telegram.me/")), ("PHONE", v.rlike(r"^tel:\+?\d+$") | v.rlike(r"^\+91\d{10}$")),
            ("URL", v.rlike("^https?://")),
        ],
        "UNKNOWN",
    )


def qr_risk(value: Column) -> Column:
    """Base risk by type, 0.15 more for a payment with an amount, at most 1 (SF-26)."""
    kind = qr_type(value)
    base = F.coalesce(F.create_map(*[F.lit(x) for p in X.QR_RISK for x in p])[kind], F.lit(0.3))
    amount = F.regexp_extract(value, r"[?&]am=([0-9.]+)", 1).try_cast("double")
    return F.round(F.least(F.lit(1.0), base + F.when((kind == "UPI_PAYMENT") & (amount > 0), 0.15).otherwise(0.0)), 2)


def url_domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]+)", 1))


def url_threats(url: Column) -> Column:
    """Shortener, scam words, suspicious ending, more than three dots (SF-36)."""
    domain = url_domain(url)
    return F.array_compact(
        F.array(
            F.when(domain.isin(X.SHORTENERS), F.lit("URL_SHORTENER")),
            F.when(any_word(url, X.URL_SCAM_WORDS), F.lit("SCAM_KEYWORDS")),
            F.when(domain.rlike("(" + "|".join(map(re.escape, X.SUSPICIOUS_TLDS)) + ")$"), F.lit("SUSPICIOUS_TLD")),
            F.when(F.regexp_count(domain, F.lit(r"\.")) > 3, F.lit("EXCESSIVE_SUBDOMAINS")),
        )
    )


def carrier(ten_digits: Column) -> Column:
    two = F.substring(ten_digits, 1, 2)
    pairs = [("Jio", F.substring(ten_digits, 1, 4).isin(X.JIO_PREFIXES) | two.isin(X.CARRIERS[0][1]))]
    pairs += [(name, two.isin(starts)) for name, starts in X.CARRIERS[1:]]
    return first_match(pairs, "Unknown")


def circle(ten_digits: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in X.CIRCLES for x in p])[F.substring(ten_digits, 1, 2)], F.lit("Unknown"))


def operator_name(ten_digits: Column) -> Column:
    """Company behind the carrier of a number (SF-38)."""
    return F.coalesce(F.create_map(*[F.lit(x) for p in X.OPERATORS for x in p])[carrier(ten_digits)], F.lit("Unknown"))


def phone_digits(phone: Column) -> Column:
    """Digits of a number without blanks, hyphens and country code."""
    bare = F.regexp_replace(phone, r"[ \-]", "")
    return F.when(bare.startswith("+91"), F.substring(bare, 4, 100)).when(
        bare.startswith("91") & (F.length(bare) > 10), F.substring(bare, 3, 100)
    ).otherwise(bare)


def phone_profile(phone: Column) -> Column:
    """(carrier, operator, circle, number_type, risk) of a number; other than ten digits are invalid (SF-38)."""
    n = phone_digits(phone)
    known = F.length(n) == 10
    place = F.when(known, circle(n)).otherwise(F.lit("Unknown"))
    kind = F.when(~known, "UNKNOWN").when(F.substring(n, 1, 1).isin("6", "7", "8", "9"), "MOBILE").otherwise("LANDLINE")
    risk = F.when(~known, F.lit("Invalid phone number format")).when(
        place.isin(X.RISKY_CIRCLES), F.concat(F.lit("High-risk telecom circle: "), place, F.lit(" (Jamtara belt)"))
    ).otherwise(F.lit(""))
    return F.struct(
        F.when(known, carrier(n)).otherwise(F.lit("Unknown")).alias("carrier"), F.when(known, operator_name(n)).otherwise(F.lit("Unknown")).alias("operator"),
        place.alias("circle"), kind.alias("number_type"), risk.alias("risk"),
    )


def people_with(overlay: list[tuple[str, str, list[str]]], removed: tuple[str, ...] = ()) -> list[tuple[str, str, list[str]]]:
    """The built-in people and those of an overlay; a built-in name wins, ``removed`` names go (SC-37)."""
    known = {name for name, _, _ in X.CELEBRITIES}
    gone = {name.lower() for name in removed}
    return [p for p in [*X.CELEBRITIES, *(p for p in overlay if p[0] not in known)] if p[0].lower() not in gone]


def celebrities(text: Column, people: list[tuple[str, str, list[str]]] | None = None) -> Column:
    """(name, kind) of every person named in a text by name or alias, in the order of the list (JN-17)."""
    known = people or X.CELEBRITIES
    words = [(word.lower(), k) for k, (name, _, aliases) in enumerate(known) for word in (name, *aliases)]
    who = F.array(*[F.lit(k) for _, k in words])
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind")) for name, kind, _ in known])
    named = F.array_sort(F.array_distinct(F.transform(word_numbers([w for w, _ in words])(F.lower(text)), lambda h: F.get(who, h))))
    return F.transform(named, lambda k: F.get(each, k))


def freeze_bank(upi: Column) -> Column:
    """Bank of a payment address as freeze requests name it (SF-39)."""
    return _bank(upi, X.FREEZE_BANKS)


def upi_bank(upi: Column) -> Column:
    return _bank(upi, X.UPI_BANKS)


def _bank(upi: Column, banks: list[tuple[str, str]]) -> Column:
    handle = F.lower(F.when(upi.contains("@"), F.split_part(upi, F.lit("@"), F.lit(-1))).otherwise(F.lit("")))
    known = F.create_map(*[F.lit(x) for p in banks for x in p])[handle]
    return F.coalesce(known, F.concat(F.lit("Unknown ("), handle, F.lit(")")))


def entity_kind(value: Column) -> Column:
    """Type of a shared value: ``+91…`` is a phone, ``@`` without a later dot a payment address (SF-41)."""
    return F.when(value.startswith("+91"), F.lit("PHONE")).when(
        value.contains("@") & ~F.split_part(value, F.lit("@"), F.lit(-1)).contains("."), F.lit("UPI")
    ).otherwise(F.lit("OTHER"))


def loss_text(victims: Column, per_victim: int = 25_000) -> Column:
    """Estimated loss in crore, lakh or plain rupees (SF-42)."""
    loss = victims * per_victim
    return (
        F.when(loss >= 10_000_000, F.concat(F.lit("₹"), F.format_string("%.1f", F.round(loss / 10_000_000.0, 1)), F.lit(" Crore")))
        .when(loss >= 100_000, F.concat(F.lit("₹"), F.format_string("%.1f", F.round(loss / 100_000.0, 1)), F.lit(" Lakh")))
        .otherwise(F.concat(F.lit("₹"), loss.cast("string")))
    )


def hashtags(text: Column, limit: int = 10) -> Column:
    return F.slice(_all(text, r"#(\w+)", 1), 1, limit)


def post_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/p/([^/]+)/", 1)


def stable_id(text: Column, length: int = 16) -> Column:
    """Leading hex digits of SHA-256 (SF-27)."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def hex_distance(a: Column, b: Column) -> Column:
    """Differing bits of two hex fingerprints of at most 16 digits."""
    return F.bit_count(F.conv(a, 16, -10).cast("long").bitwiseXOR(F.conv(b, 16, -10).cast("long")))


def phash_similarity(a: Column, b: Column) -> Column:
    """1 - differing bits / (4 * length); 0 for unequal lengths or empty values (SF-28)."""
    same = (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(same, 1 - hex_distance(a, b) / (4 * F.length(a))).otherwise(F.lit(0.0))


def heuristic_label(text: Column) -> Column:
    """Label of the first keyword list with a whole-word hit, -1 without (DM-18)."""
    low = F.lower(text)
    out = None
    for label, words in X.HEURISTIC_KEYWORDS:
        hit = low.rlike(r"\b(?:" + "|".join(w.replace("-", r"\-") for w in words) + r")\b")
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(-1))


def rule_category(text: Column) -> Column:
    """Category with the most pattern hits, at least two, the earlier one wins ties (DM-5)."""
    low = F.lower(text)
    hits = [reduce(lambda a, b: a + b, [matches(low, p).cast("int") for p in patterns]) for _, patterns in X.RULE_PATTERNS]
    return most_hits(hits)


def most_hits(hits: list[Column]) -> Column:
    """Category of the most of these hits, at least two, the earlier one wins ties."""
    # the greatest of (hits, earlier, name) makes each count once, in generated code; one hit or null loses against the default
    ranked = [F.struct(h.alias("hits"), F.lit(-k).alias("earlier"), F.lit(name).alias("name")) for k, (h, (name, _)) in enumerate(zip(hits, X.RULE_PATTERNS, strict=True))]
    return F.greatest(F.struct(F.lit(1).alias("hits"), F.lit(1).alias("earlier"), F.lit("UNKNOWN").alias("name")), *ranked)["name"]


def rule_bits(text: Column, patterns: list[str]) -> Column:
    """Which of the patterns the lower-cased text matches, a bit each."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(matches(low, p), F.lit(1 << k)).otherwise(F.lit(0)) for k, p in enumerate(patterns)]).cast("long")


def impersonated(text: Column) -> Column:
    """The first organisation that a text names, where it also has a scam context, else an empty string (DM-4)."""
    low = F.lower(text)
    named = first_match([(who, F.coalesce(low.contains(word), F.lit(False))) for word, who in X.IMPERSONATION], "")
    return F.when(any_word(text, X.SCAM_CONTEXT), named).otherwise(F.lit(""))


def financial_promise(text: Column) -> Column:
    """What the first pattern of promises finds in the lower-cased text, at most 80 characters, else an empty string (DM-4)."""
    low = F.lower(text)
    found = [F.nullif(F.regexp_extract(low, p, 0), F.lit("")) for p in X.FINANCIAL_PROMISES]
    return F.substring(F.coalesce(*found, F.lit("")), 1, 80)


def campaign_name(text: Column) -> Column:
    """Name of a campaign by the first family of words, with the first place that the text names (DM-13)."""
    low = F.lower(text)
    place = F.initcap(F.regexp_extract(low, X.PLACES, 1))
    return F.concat(first_match([(n, low.rlike(p)) for n, p in X.CAMPAIGN_NAMES], "Unidentified Scam Network"), F.when(place != "", F.concat(F.lit(" — "), place)).otherwise(F.lit("")))


def phone_numbers(text: Column, in_words: Column | None = None) -> Column:
    """Numbers of every format as (normalized, format_type, confidence), the first format that finds one names it (SF-5).

    ``in_words``: numbers written as words (:func:`vigilspark.functions.udfs.word_form_phones`), a
    format that takes an Arrow function.
    """

    def tagged(values: Column, kind: str, confidence: float) -> Column:
        return F.transform(values, lambda x: F.struct(x.alias("normalized"), F.lit(kind).alias("format_type"), F.lit(confidence).alias("confidence")))

    coded = lambda values: F.transform(values, lambda x: F.concat(F.lit("+91-"), x))
    standard = F.filter(F.transform(_all(text, X.PHONE), lambda x: normalised_phone(x)), lambda x: x != "")
    spoken = F.array().cast("array<string>") if in_words is None else in_words
    every = F.concat(
        tagged(standard, "STANDARD", 1.0), tagged(coded(whatsapp_phones(text)), "WHATSAPP_LINK", 1.0), tagged(coded(disguised_phones(text)), "DISGUISED", 0.7),
        tagged(coded(spoken), "WORD_FORM", 0.6),
    )
    # as a variable of a lambda the numbers are found once, not again for each of them
    first = lambda found: F.filter(found, lambda p, i: F.array_position(found["normalized"], p["normalized"]) == i + 1)
    return F.get(F.transform(F.array(every), first), 0)


def indicators(phones: Column, upis: Column, urls: Column) -> Column:
    """What a classified text shows, as sentences with counts (RM-8)."""
    told = [("Phone numbers", phones), ("UPI IDs", upis), ("Suspicious URLs", urls)]
    return F.array_compact(F.array(*[F.when(n > 0, F.concat(F.lit(f"{label} detected: "), n.cast("string"))) for label, n in told]))


def sms_text(severity: Column, campaign: Column, trigger: Column, action: Column) -> Column:
    """An alert of at most 160 characters (RM-27)."""
    lines = F.concat(F.lit("["), severity, F.lit("] "), campaign, F.lit("\n"), F.substring(trigger, 1, 80), F.lit("\nAction: "), F.substring(action, 1, 60))
    return F.substring(lines, 1, 160)


def intent(text: Column) -> Column:
    """(category, confidence, urgency) of a text by its most confident reading (DM-19); earlier readings win ties."""
    celebrity = any_word(text, X.CELEBRITY_WORDS)
    invest, threat, arrest = (word_hits(text, w) for w in (X.INVESTMENT_WORDS, X.SEXTORTION_WORDS, X.ARREST_WORDS))
    department = any_word(text, [w for _, words in X.DEPARTMENTS for w in words])
    capped = lambda c: F.least(F.lit(0.95), c)
    none = F.lit(-1.0)
    readings = [
        ("CELEBRITY_INVESTMENT_SCAM", "CRITICAL", F.when(celebrity & (invest >= 2), capped(0.7 + invest * 0.05)).otherwise(none)),
        ("FAKE_ENDORSEMENT", "HIGH", F.when(celebrity & (invest < 2), F.lit(0.7 * 0.7)).otherwise(none)),
        ("SEXTORTION", "CRITICAL", F.when(threat >= 2, capped(0.5 + threat * 0.1)).otherwise(none)),
        ("DIGITAL_ARREST", "CRITICAL", F.when(department, capped(0.4 + arrest * 0.1) + 0.2).otherwise(none)),
        ("GENERIC_CONTENT", "LOW", F.lit(0.3)),
    ]
    some = F.greatest(*[c for _, _, c in readings[:4]]) > 0
    ranked = [
        F.struct(F.round(c, 4).alias("confidence"), F.lit(-k).alias("order"), F.lit(n).alias("category"), F.lit(u).alias("urgency"))
        for k, (n, u, c) in enumerate(readings)
    ]
    return F.when(some, F.array_max(F.array(*ranked[:4]))).otherwise(ranked[4])


def use_case(text: Column) -> Column:
    """What a manipulated image with this text is for (DM-20)."""
    celebrity, invest = any_word(text, X.CELEBRITY_WORDS), any_word(text, X.USE_INVESTMENT)
    return first_match(
        [
            ("SEXTORTION", any_word(text, X.USE_SEXTORTION)), ("DIGITAL_ARREST", any_word(text, X.USE_ARREST)), ("FAKE_ENDORSEMENT", celebrity & invest),
            ("INVESTMENT_SCAM", invest), ("FAKE_ENDORSEMENT", celebrity), ("DIGITAL_ARREST", any_word(text, X.OFFICIAL_WORDS)),
        ],
        "OTHER",
    )


def investment_claim(text: Column) -> Column:
    """The first span that reads as an investment claim, or an empty string (SF-49)."""
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in X.CLAIMS]
    return F.trim(F.coalesce(*found, F.lit("")))


def reach_estimate(n_urls: Column, n_telegram: Column, n_whatsapp: Column) -> Column:
    """How far a message is likely to spread, by its links (SF-48)."""
    return first_match([("HIGH", (n_telegram > 0) | (n_whatsapp > 0)), ("MEDIUM", n_urls > 2), ("LOW-MEDIUM", n_urls > 0)], "LOW")


def domain_risk(domain: Column, age_days: Column, privacy: Column, country: Column) -> Column:
    """Risk of a domain from its registration (SF-37)."""
    parts = [
        F.when(age_days < 30, 30).otherwise(0), F.when(age_days < 90, 15).otherwise(0), F.when(privacy, 10).otherwise(0),
        F.when(country.isNotNull() & ~country.isin("IN", "India"), 15).otherwise(0), F.when(any_word(domain, X.DOMAIN_WORDS), 20).otherwise(0),
    ]
    return F.least(F.lit(100), reduce(lambda a, b: a + b, parts))


def ocr_postfix(text: Column) -> Column:
    """Spacing and frequent misreads of recognised text (SF-23)."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F.regexp_replace(out, r"\b[^a-zA-Z0-9₹@./:+-]\b", " ")
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), X.OCR_FIXES, out)
    out = F.regexp_replace(out, r"(\+91)\s*[-.]?\s*(\d)", "$1-$2")
    out = F.regexp_replace(out, r"(\w+)\s*@\s*(\w+)", "$1@$2")
    out = F.regexp_replace(out, r"https?\s*:\s*/\s*/", "https://")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def image_type(aspect: Column, top: Column, bottom: Column, laplacian: Column, saturation: Column, value: Column, white: Column, dark: Column, deviation: Column) -> Column:
    """Kind of image from nine pixel statistics (SF-54)."""
    return first_match(
        [
            ("SCREENSHOT", (aspect > 1.5) & (top < 25) & (bottom < 30)), ("WHATSAPP_FORWARD", (laplacian < 80) & (aspect > 1.2)),
            ("DESIGNED_GRAPHIC", (saturation > 80) & (value > 100)), ("HANDWRITTEN", (white > 0.6) & (dark > 0.02) & (deviation < 80)),
        ],
        "PHOTO",
    )
