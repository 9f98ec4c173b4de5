"""Extraction and classification on hand-made texts."""

import re

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import text as T
from vigilspark.functions.udfs import name_similarity, nfc, spoken_numbers, username_similarity, word_form_phones


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("fn", "text", "want"),
    [
        (T.phones, "call 09876543210 or +91-9876543210, 5876543210", ["9876543210"]),
        (T.phones, None, []),
        (T.normalised_phone, "098765 43210", "+91-9876543210"),
        (T.normalised_phone, "12345", ""),
        (T.disguised_phones, "dial 98OO12345 l", ["9800123451"]),
        (T.whatsapp_phones, "wa.me/919876543210 wa.me/5555555555", ["9876543210"]),
        (T.upis, "A@ybl x@gmail.com name@averylonghandle", ["a@ybl"]),
        (T.urls, "see (https://a.example/x). or bit.ly/abc, http://a", ["bit.ly/abc", "https://a.example/x"]),
        (T.telegram_links, "https://t.me/abc/12 and @hello_1 @gmail", ["@hello_1", "t.me/abc/12"]),
        (T.whatsapp_groups, "chat.whatsapp.com/ABCDEFGHIJKLMNOP chat.whatsapp.com/short", ["chat.whatsapp.com/ABCDEFGHIJKLMNOP"]),
        (T.bank_accounts, "a/c 123456789012", ["123456789012"]),
        (T.bank_accounts, "a/c 009876543210", []),
        (T.bank_accounts, "number 123456789012", []),
        (T.ifsc_codes, "SBIN0001234 sbin0001234", ["SBIN0001234"]),
        (T.amounts, "Rs. 5,000 or 250 rupees or ₹0", ["₹250", "₹5000"]),
        (T.mask_pii, "a@bank.com", "***UPI***.com"),
        (T.mask_pii, "call +91 9876543210, ABCDE1234F, 1234 5678 9012", "call ***PHONE***, ***PAN***, ***AADHAAR***"),
        (T.script_language, "नमस्ते", "hindi"),
        (T.script_language, "hello", "english"),
        (T.script_language, "123", "unknown"),
        (T.clean_text, "9O8 पेसे  burn the  web.corn sterns", "908 पैसे burn the web.corn stems"),
        (T.heuristic_label, "I like torrent", 11),
        (T.heuristic_label, "mukesh ambani job", 7),
        (T.heuristic_label, "kbc lottery", 4),
        (T.heuristic_label, "nothing here", -1),
        (T.rule_category, "digital arrest by cbi officer", "DIGITAL_ARREST"),
        (T.rule_category, "digital arrest", "UNKNOWN"),
        (T.qr_type, "upi://pay?pa=a@ybl&am=100", "UPI_PAYMENT"),
        (T.qr_risk, "upi://pay?pa=a@ybl&am=100", 0.85),
        (T.qr_risk, "https://x.example", 0.5),
        (T.qr_type, "tel:+911234567890", "PHONE"),
        (T.parse_count, "1.2K", 1200), (T.parse_count, "5M", 5_000_000), (T.parse_count, "1,234", 1234), (T.parse_count, "abc", 0),
        (T.url_domain, "https://A.Example.com/x?y", "a.example.com"),
        (T.url_threats, "http://a.b.c.d.win-money.xyz/double", ["SCAM_KEYWORDS", "SUSPICIOUS_TLD", "EXCESSIVE_SUBDOMAINS"]),
        (T.carrier, "7012345678", "Airtel"), (T.carrier, "7000123456", "Jio"), (T.circle, "6312345678", "Jharkhand"),
        (T.upi_bank, "x@OKSBI", "SBI"), (T.upi_bank, "x@kotak", "Unknown (kotak)"),
        (T.entity_kind, "+919876543210", "PHONE"), (T.entity_kind, "a@ybl", "UPI"), (T.entity_kind, "a@b.com", "OTHER"),
        (T.hashtags, "#one two #three", ["one", "three"]), (T.post_id, "https://x/p/AbC/", "AbC"),
        (T.violation_type, "satta matka", "BETTING_GAMBLING"), (T.severity, "zero-day in x", "CRITICAL"),
        (T.complaint_entities, "+91 9876543210 a@ybl t.me/x http://t.me/x", ["PHONE:+91 9876543210", "UPI:a@ybl", "URL:http://t.me/x", "TELEGRAM:t.me/x", "SOCIAL:@ybl"]),
    ],
)
def test_text_function(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_promises(spark):
    got = one(spark, T.promises, "guaranteed return! Guaranteed return, paisa double, 20% profit")
    assert [(p["text"], p["promise_type"], p["language"]) for p in got] == [
        ("20% profit", "RETURN_PERCENT", "ENGLISH"), ("guaranteed return", "GUARANTEED", "ENGLISH"), ("Guaranteed return", "GUARANTEED", "ENGLISH"), ("paisa double", "DOUBLE_MONEY", "HINDI"),
    ]


def test_encryption(spark):
    df = spark.createDataFrame([("secret", "k" * 32), ("", "k" * 32)], "t string, k string")
    enc = df.select("t", "k", T.encrypt_pii(F.col("t"), F.col("k")).alias("e")).cache()
    rows = enc.select("t", "e", T.decrypt_pii(F.col("e"), F.col("k")).alias("d")).collect()
    assert rows[0]["e"].startswith("ENC:") and rows[0]["d"] == "secret" and rows[1]["e"] == ""


def test_phash_similarity(spark):
    assert one(spark, T.phash_similarity, "ffff", "fffe") == pytest.approx(1 - 1 / 16)
    assert one(spark, T.phash_similarity, "ffff", "ff") == 0.0


def test_loss(spark):
    rows = spark.createDataFrame([(1,), (10,), (500,)], "v long").select(T.loss_text(F.col("v")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["₹25000", "₹2.5 Lakh", "₹1.3 Crore"]


def test_spoken_numbers(spark):
    said = "Call nine eight zero zero one two three four five six now; number: ek do"
    assert spoken_numbers(said) == ["9800123456"]
    assert spoken_numbers("nine eight zero zero one two three four five six") == [] and spoken_numbers(None) == []
    df = spark.createDataFrame([(said,), (None,)], "t string")
    assert [r["x"] for r in df.select(word_form_phones("t").alias("x")).collect()] == [["9800123456"], []]
    assert [r["x"] for r in df.select(nfc("t").alias("x")).collect()] == [said, None]


def test_name_similarity(spark):
    assert name_similarity("@Quick_Money.1", "quickmoney22") == 1.0 and name_similarity("abc", "xyz") == 0.0
    df = spark.createDataFrame([("ab", "abc")], "a string, b string")
    assert df.select(username_similarity("a", "b").alias("x")).first()["x"] == pytest.approx(0.8)


def test_needed_literals():
    """Every rule pattern has its literal, and no match of a pattern lacks it."""
    from vigilspark.functions import fixed as X

    assert T.needed_literal(r"\bcongratulations?\s+you\s+won\b") == "congratulation" and T.needed_literal(r"\ba|b\b") == ""
    assert T.needed_literal(r"\b\d+%\s*(?:return|profit)\b") == "%" and T.needed_literal(r"[ab]c") == "" and T.needed_literal("abc{2}d") == ""
    words = ["investment", "investing", "guaranteed return", "double your money", "double money", "stock tip", "stock tips", "mutual fund", "share market", "forex trading",
             "crypto profits", "ponzi", "zero risk", "monthly income", "paisa dugna", "pakka munafa", "20% profit", "betting tip", "cricket prediction", "ipl toss", "satta matka",
             "match fixing", "toss winner", "casino online", "win big money", "digital arrest", "cbi officer", "enforcement directorate", "ed notice", "arrest warrant", "court order",
             "fir registered", "customer care", "helpline number", "kyc update", "account blocked", "toll free", "bank alert", "trai notice", "work from home", "part time job",
             "online job", "typing job", "data entry job", "earn daily", "registration fee", "lottery winner", "lucky draw", "kbc winner", "prize money", "congratulation you won",
             "congratulations you won", "claim your prize", "claim prize", "whatsapp lottery", "instant loan", "loan approved", "loan app", "no document loan", "advance fee", "processing fee"]
    patterns = [p for _, group in X.RULE_PATTERNS for p in group]
    assert all(any(re.search(p, w) for w in words) for p in patterns)
    assert all(T.needed_literal(p) and T.needed_literal(p) in w for p in patterns for w in words if re.search(p, w))
