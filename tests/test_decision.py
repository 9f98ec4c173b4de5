"""Inputs of the decision score against plain loops over small channels with planted marks."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import text as T
from vigilspark.operators import decision as D
from vigilspark.operators import intel as I

DAY = datetime(2024, 1, 1)
TEXTS = "channel long, message_id long, text string"
POSTS = "channel long, message_id long, ts timestamp, forwards int, media string"


def collected(text):
    out = []
    for kind, p in (("PHONE", X.COLLECTED_PHONE), ("UPI", X.COLLECTED_UPI), ("URL", X.COLLECTED_URL), ("TELEGRAM", X.COLLECTED_LINK)):
        out += [(kind, m.group(0)) for m in re.finditer(p, text or "")]
    return list(dict.fromkeys(out))


def test_collected_entities(spark):
    texts = [
        "call +91 98765 43210 or 98765-43210, 5987654321", "pay Ravi.k@YBL or x@okicici, not x@nobank or y@fine", "www.a.top/x http://b.club/1?q=2 end", "t.me/joinchat/AbC https://t.me/one/5 @four @abc @name_9",
        "", None, "scan the code", "a@fi b@slice",
    ]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", T.collected_entities(F.col("text")).alias("e")).collect()
    assert {r["id"]: [tuple(x) for x in r["e"]] for r in got} == {k: collected(t) for k, t in enumerate(texts)}
    kinds = {r["id"]: [x["value"] for x in r["e"]] for r in got}
    assert kinds[1] == ["Ravi.k@YBL", "x@okicici", "@okicici", "@nobank", "@fine"] and "5987654321" not in " ".join(kinds[0])


def test_linked_channels(spark):
    e = spark.createDataFrame([(1, "TELEGRAM", v) for v in ("https://t.me/one/5", "@one", "@self", "http://t.me/two", "t.me/bare")] + [(2, "URL", "https://t.me/x")], "channel long, entity_type string, value string")
    names = spark.createDataFrame([(1, "self"), (1, None), (2, "two")], "channel long, name string")
    assert sorted(tuple(r) for r in D.linked_channels(e, names).collect()) == [(1, "one"), (1, "t.me"), (1, "two")]


def signals(spark, posts=(), texts=(), names=(), blocked=(), domains=(), snapshots=(), similarity=(), classified=(), campaigns=(), **more):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    found = D.decision_signals(
        df(posts, POSTS), df(texts, TEXTS), df(names, "channel long, name string"), df(blocked, "entity_type string, value string"), df(domains, "domain string"),
        df(snapshots, "channel long, date timestamp, subscribers long"), df(similarity, "channel long, similarity double"), df(classified, "channel long, confidence double"), df(campaigns, "channel long, campaign long"), **more,
    )
    return {r["channel"]: r for r in found.collect()}


def test_signals_of_planted_channels(spark):
    urls = [f"http://h{k:02d}.example/a" for k in range(12)]
    texts = [(1, k, f"see {u}") for k, u in enumerate(urls)] + [(1, 20, "moved to @other, also https://t.me/bad/3 and @mine"), (1, 21, None), (1, 22, "urgent: scan QR, pay a@ybl"), (1, 22, "urgent: scan QR, pay a@ybl")]
    texts += [(2, k, "98765 43210 " + ("अभी पैसा भेजो जल्दी" if k % 2 else "plain")) for k in range(150)] + [(2, 500, "98765 43211"), (2, 501, "9876543212 a@ybl"), (None, 1, "urgent")]
    posts = [(1, m, DAY, 1, "images") for m in (10, 11, 12, 13)] + [(1, 20, DAY, 0, "none")] + [(3, 0, None, 0, "none")]
    got = signals(
        spark, posts, texts, names=[(1, "mine"), (4, "quiet")], blocked=[("URL", urls[0]), ("URL", urls[0]), ("URL", "http://no"), ("CHANNEL", "bad"), ("CHANNEL", None)], domains=[("h01.example",), ("h0",), (None,)],
        snapshots=[(1, DAY, 9), (1, DAY + timedelta(1), 20_000)], similarity=[(2, 0.7)], classified=[(2, 0.9)], campaigns=[(1, 5), (1, 5), (1, 6)],
    )
    assert sorted(got) == [1, 2, 3, 4]
    one, two = got[1], got[2]
    assert (one["xref_hits"], one["domain_hits"], one["overlap"]) == (2, 10, 2 + 11)  # h00..h09, the second by two domains
    assert (one["upis"], one["phones"], one["linked"], one["connections"], one["campaigns"], one["backup"]) == (1, 0, 2, 1, 2, 1)
    assert (one["forward_ratio"], one["image_pct"], one["subscribers"]) == (0.8, 80.0, 20_000.0)
    assert abs(one["deletion_rate"] - (1 - 5 / 11)) < 1e-12 and abs(one["urgency_pct"] - 2 / 16 * 100) < 1e-9 and one["has_qr"] and not one["bad_tld"]
    assert (two["urgency_pct"], two["phones"], two["upis"], two["similarity"], two["confidence"]) == (50.0, 3, 1, 0.7, 0.9)  # the first hundred texts alone
    assert two["hinglish"] == 0.0 and all(got[4][c] == 0 for c in D.COUNTS + D.SHARES) and not got[3]["has_qr"]
    scored = I.decision_score(spark.createDataFrame(list(got.values()))).collect()
    assert {r["channel"]: r["decision"] for r in scored}[4] == "IGNORE"


def test_first_addresses_by_value(spark):
    texts = [(1, k, f"http://{c}.example/") for k, c in enumerate("abcdefghij")] + [(1, 50, "http://z.CLUB/"), (2, 1, "http://z.CLUB/")]
    got = signals(spark, texts=texts)
    assert not got[1]["bad_tld"] and got[2]["bad_tld"]


def test_empty_tables_and_long_texts(spark):
    assert signals(spark) == {}
    got = signals(spark, texts=[(1, 1, "urgent " * 200_000 + "http://x.top/")])
    assert got[1]["urgency_pct"] == 100.0 and got[1]["bad_tld"]


def test_schedule_similarity(spark):
    posts = [(1, k, DAY + timedelta(hours=h), 0, "none") for k, h in enumerate((0, 0, 5))] + [(2, 1, DAY + timedelta(hours=24 * 7), 0, "none"), (3, 1, DAY + timedelta(hours=9), 0, "none"), (4, 1, None, 0, "none")]
    df, known = spark.createDataFrame(posts, POSTS), spark.createDataFrame([(1,), (1,), (9,)], "channel long")
    got = {r["channel"]: r["similarity"] for r in D.schedule_similarity(df, known).collect()}
    assert got == {1: 1.0, 2: round(2 / 5**0.5, 6), 3: 0.0}  # a week later is the same hour of the week
    assert D.schedule_similarity(df, known.limit(0)).count() == 0


def test_texts_of_channels_are_collected_once(spark, monkeypatch):
    from vigilspark.operators import decision
    from vigilspark.plans import decision_plans

    calls, collect = [], decision.collected
    monkeypatch.setattr(decision, "collected", lambda texts: calls.append(1) or collect(texts))
    decision_plans.decision_signals(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
