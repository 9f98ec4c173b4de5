"""Domain operators against hand-worked values and brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.functions import scores as S
from vigilspark.functions import text as T
from vigilspark.operators.neighbours import nearest
from vigilspark.operators import behaviour as B
from vigilspark.operators import cases as C
from vigilspark.operators import evaluation as E
from vigilspark.operators import intel as I
from vigilspark.operators import linking as L
from vigilspark.plans.intel_plans import verify_chains


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_thresholds(spark):
    assert [one(spark, S.decision(F.lit(v))) for v in (85, 84.9, 50, 30, 0)] == ["BLOCK", "ESCALATE", "INVESTIGATE", "MONITOR", "IGNORE"]
    assert [one(spark, S.risk_level(F.lit(v))) for v in (75, 50, 25, 1)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert one(spark, S.case_severity(F.lit("LOW"), F.lit(0.4), F.lit(0.31))) == "MEDIUM"


def test_formulas(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, S.entropy(arr(*[1] * 24))) == 1.0
    assert one(spark, S.entropy(arr(0, 7, 0))) == 0.0 and one(spark, S.entropy(arr(0, 0))) == 0.0
    assert one(spark, S.entropy(arr(0.5, 0.25, 0.25))) == 0.9464
    assert one(spark, S.campaign_risk(F.lit(3), F.lit(2), F.lit(2), F.lit(20_000))) == 35.0
    assert one(spark, S.graph_risk(F.lit("MEDIUM"), F.lit(3), F.lit(2), F.lit(1), F.lit(100))) == pytest.approx(55.62)
    assert one(spark, S.decay(F.lit(24.0))) == pytest.approx(0.6065, abs=1e-4)
    assert one(spark, S.cosine(arr(1, 0), arr(0, 0))) == 0.0 and one(spark, S.cosine(arr(1, 2), arr(2, 4))) == pytest.approx(1)
    assert one(spark, S.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_attribution_values(spark):
    """Full overlap of payment addresses and phones, equal behaviour, same category: 0.3318; with a 24 h gap 0.7595."""
    shared = [(c, k, v) for c in (1, 2) for k, v in (("UPI", "u"), ("PHONE", "p"))]
    t = datetime(2024, 1, 1)
    for gap, want, strength in ((None, 0.3318, "INSUFFICIENT"), (24, 0.7595, "PROBABLE")):
        rows = [(1, [1.0, 2.0], "A", "", False, t if gap else None, t, 0), (2, [1.0, 2.0], "A", "", False, None, t + timedelta(hours=gap or 0), 0)]
        chans = spark.createDataFrame(rows, "channel long, vector array<double>, category string, impersonated string, promises boolean, taken_down timestamp, created timestamp, n_evidence long")
        got = L.attribution(chans, spark.createDataFrame(shared, "channel long, entity_type string, value string"), 0.2).collect()
        assert [(r["probability"], r["strength"]) for r in got] == [(pytest.approx(want, abs=1e-4), strength)]
    with pytest.raises(ValueError, match="lossless"):
        L.attribution(chans, spark.createDataFrame(shared, "channel long, entity_type string, value string"), 0.01)


def test_four_places_equal_round(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(3000)] + [k / 20_000 for k in range(3000)] + [0.0, 1.0, -0.3, 1.7, float("nan"), float("inf"), None, 0.00005, 0.99995, 1e-12]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.four_places(F.col("x")).alias("got"), F.round("x", 4).alias("want"))
    assert df.where("not (got <=> want)").count() == 0


def test_jaccard_counts_pairs_once(spark):
    rows = [(1, "UPI", "x"), (2, "UPI", "x"), (2, "UPI", "y"), (1, "QR", "z"), (3, "QR", "z"), (1, "IMAGE", "i"), (2, "IMAGE", "i")]
    got = L.jaccard_by_type(spark.createDataFrame(rows, "channel long, entity_type string, value string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 3  # one of pairs, the sizes of both sides
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0.5, 0.0, 0.0, 1.0), (1, 3, 0.0, 0.0, 0.0, 0.0)]


def test_attribution_pairs_are_not_shuffled(spark):
    """Pairs near in time are made and scored in the task that joins them: nothing after the join moves them."""
    t = datetime(2024, 1, 1)
    chans = spark.range(30).select(
        F.col("id").alias("channel"), F.array(F.lit(1.0), F.col("id") / 7).alias("vector"), F.lit("A").alias("category"), F.lit("").alias("impersonated"), F.lit(True).alias("promises"),
        F.lit(t).alias("taken_down"), F.lit(t).alias("created"), F.lit(1).cast("long").alias("n_evidence"),
    )
    ents = spark.createDataFrame([(c, "UPI", str(c // 3)) for c in range(30)], "channel long, entity_type string, value string")
    got = L.attribution(chans, ents, 0.1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("known", 1)[0] and "Distinct" not in plan
    pairs = [(r["a"], r["b"]) for r in got.collect()]
    assert sorted(pairs) == [(a, b) for a in range(30) for b in range(a + 1, 30)]
    near = L.close_in_time(chans, 5.0, ents.sparkSession.createDataFrame([(0, 1)], "a long, b long"), block=4)
    assert near.count() == 30 * 29 // 2 - 1


def posts(spark, rows):
    return spark.createDataFrame(rows, "channel long, message_id long, ts timestamp_ntz, views long, reactions int, forwards int, replies int, media string")


def test_behaviour(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, t, 10, 1, 0, 0, "images"), (1, 2, t + timedelta(minutes=5), 0, 1, 1, 0, "links"), (1, 5, t + timedelta(days=31), 20, 0, 0, 0, "none"), (2, 7, None, 1, 0, 0, 0, "none")]
    df = posts(spark, rows)
    c = {r["channel"]: r for r in B.counters(df).collect()}
    assert c[1]["deletion_rate"] == 0.4 and c[2]["deletion_rate"] == 0.0 and c[1]["engagement"] == pytest.approx(0.7)
    assert B.silence(df).collect()[0]["silence"] == 1.0
    d = B.daily_rhythm(df).collect()[0]
    assert (d["posts"], d["posts_per_day_mean"], d["posts_per_day_std"], d["observation_days"]) == (3, 1.5, 0.5, 31) and d["regularity"] == pytest.approx(0.6667)
    assert B.burst(df).collect()[0]["burst"] == 1.33
    s = B.posting_schedule(df).collect()[0]
    assert s["peak_hour"] == 0.0 and s["schedule"][0] == 1.0


def test_viral(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 9, t, "a", 1, 4000), (2, 9, t + timedelta(hours=4), "b", 2, 3000), (3, 9, t + timedelta(hours=1), "a", 3, 3000)]
    df = spark.createDataFrame(rows, "id long, image long, ts timestamp, platform string, channel long, reach long")
    r = I.viral_spread(df).first()
    assert (r["velocity"], r["score"], r["first_platform"]) == (0.75, 49.0, "a")


def test_decision_score(spark):
    zero = {c: 0 for c in ("linked", "connections", "campaigns", "overlap", "subscribers", "urgency_pct", "backup")} | {c: 0.0 for c in ("forward_ratio", "similarity", "deletion_rate", "confidence", "image_pct", "hinglish")}
    row = zero | {"channel": 1, "xref_hits": 1, "domain_hits": 3, "upis": 0, "phones": 0, "bad_tld": False, "has_qr": False}
    assert I.decision_score(spark.createDataFrame([row])).first()["infrastructure"] == 70.0  # the third domain is not counted
    row |= {"xref_hits": 4, "domain_hits": 2}
    assert I.decision_score(spark.createDataFrame([row])).first()["infrastructure"] == 65.0  # 40 + 25 reaches 65, where counting stops


def test_recommendation_rules(spark):
    rows = [(1, 5, "HIGH", 2, 3, 1.0, 200), (2, 5, "MODERATE", 1, 1, 1.0, 200), (3, 5, "LOW", 3, 3, 1.0, 200), (4, 3, "LOW", 1, 1, 0.2, 200), (5, 3, "LOW", 1, 1, 1.0, 2), (6, 2, "LOW", 1, 1, 0.1, 1), (7, 0, "INSUFFICIENT", 0, 0, 1.0, 9)]
    df = spark.createDataFrame(rows, "channel int, rank int, confidence_class string, sources int, n_items int, completeness double, n_posts int")
    got = {r["channel"]: (r["action"], r["urgency"], r["suppression"]) for r in I.recommendation(df).collect()}
    assert got == {
        1: ("TAKEDOWN_REQUEST", "IMMEDIATE", ""), 2: ("TAKEDOWN_REQUEST", "24_HOURS", "SOURCES"), 3: ("ANALYST_REVIEW", "ROUTINE", ""), 4: ("ANALYST_REVIEW", "ROUTINE", "COMPLETENESS"),
        5: ("ANALYST_REVIEW", "ROUTINE", "POSTS"), 6: ("AUTOMATED_MONITORING", "DEFERRED", ""), 7: ("NO_ACTION", "DEFERRED", ""),
    }


def test_confidence_value(spark):
    chans = spark.createDataFrame([("a", 5, 10), ("b", 7, 10)], "channel string, populated int, n_posts int")
    items = spark.createDataFrame([("a", "X", "s1", "v", "WEAK"), ("a", "Y", "s2", "v", "STRONG")], "channel string, evidence_type string, source string, value string, strength string")
    got = {r["channel"]: r for r in I.confidence(chans, items).collect()}
    assert got["a"]["overall"] == pytest.approx(0.35475, abs=1e-4) and got["a"]["confidence_class"] == "LOW" and got["a"]["sources"] == 2
    assert got["b"]["confidence_class"] == "INSUFFICIENT" and got["b"]["rank"] == 0


def test_roles(spark):
    rows = [("u", "Join now, click link"), ("u", "forward this to all"), ("v", "hello"), ("w", "send +919876543210 by gpay")]
    got = {r["user"]: (r["role"], r["confidence"], r["activity"]) for r in I.roles(spark.createDataFrame(rows, "user string, text string")).collect()}
    assert got == {"u": ("RECRUITER", pytest.approx(0.67), 4.0), "v": ("UNKNOWN", 0.3, 2.0), "w": ("MONEY_MULE", pytest.approx(0.49), 5.0)}


def test_phash_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    hashes = []
    for _ in range(30):
        h = rng.getrandbits(64)
        hashes.append(h)
        for _ in range(4):
            x = h
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            hashes.append(x)
    signed = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 4)
    found = [tuple(r) for r in L.phash_pairs(spark.createDataFrame(signed, "id long, phash long")).collect()]
    # copies are given once, with the smallest id of their class: expanded, the pairs are all pairs
    members = {i: [j for j, g in enumerate(hashes) if g == h] for i, h in enumerate(hashes) if i == hashes.index(h)}
    every = {(min(x, y), max(x, y), d) for a, b, d in found if d for x in members[a] for y in members[b]}
    every |= {(x, y, 0) for m in members.values() for x in m for y in m if x < y}
    assert sorted(every) == want and {(a, b) for a, b, d in found if not d} == {(a, x) for a, m in members.items() for x in m[1:]}


def test_phash_copies_are_classes(spark):
    rows = spark.createDataFrame([(3, 7), (1, 7), (2, 7), (9, 6), (None, 7), (5, None)], "id long, phash long")
    assert sorted(map(tuple, L.phash_pairs(rows).collect())) == [(1, 2, 0), (1, 3, 0), (1, 9, 1)]


def test_phash_keys_are_not_broadcast(spark, tmp_path):
    """Fifteen keys a hash are not in the estimate, so no side of the pair join goes through the driver."""
    spark.range(2000).select("id", F.xxhash64("id").alias("phash")).write.parquet(str(tmp_path / "images"))
    found = L.phash_pairs(spark.read.parquet(str(tmp_path / "images")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fuzzy_first_seen_equals_one_pass_in_order(spark):
    """A repeat is not stored, so a post near only to a repeat is new."""
    rng = random.Random(12)
    hashes, rows = [rng.getrandbits(63) for _ in range(8)], []
    for i in range(300):
        h = rng.choice(hashes)
        for b in rng.sample(range(63), rng.randrange(5)):
            h ^= 1 << b
        if rng.random() < 0.2:
            hashes.append(h)
        rows.append((i, h))
    stored, want = [], {}
    for i, h in rows:
        near = [j for j, g in stored if (g ^ h).bit_count() <= 4]
        want[i] = near[0] if near else None
        if not near:
            stored.append((i, h))
    rows += [(1000, None)]
    want[1000] = None
    got = L.first_seen_fuzzy(spark.createDataFrame(rows, "id long, phash long")).collect()
    assert {r["id"]: r["canonical"] for r in got} == want and all(r["duplicate"] == (r["canonical"] is not None) for r in got)
    assert L.first_seen_fuzzy(spark.createDataFrame([], "id long, phash long")).count() == 0


def test_fuzzy_first_seen_is_not_broadcast(spark, tmp_path):
    spark.range(2000).select("id", F.xxhash64(F.floor(F.col("id") / 2)).alias("phash")).write.parquet(str(tmp_path / "images"))
    found = L.first_seen_fuzzy(spark.read.parquet(str(tmp_path / "images")))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.where("duplicate").count() == 1000


def test_greedy_choice_of_large_components_and_chains(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample(range(400), 2))) for _ in range(700)} | {(1000 + k, 1001 + k) for k in range(3000)}
    out = set()
    for a, b in sorted(edges, key=lambda e: (e[1], e[0])):
        if a not in out:
            out.add(b)
    df = spark.createDataFrame(list(edges), "before long, after long")
    for most in (10_000, 900):
        assert {r["node"] for r in L.first_in_order(df, most).collect()} == out
    assert L.first_in_order(df.where("false")).count() == 0


def test_cascade_equals_the_loop(spark):
    import hashlib

    rng = random.Random(6)
    hashes = [rng.getrandbits(62) for _ in range(25)]
    rows = []
    for i in range(400):
        h = rng.choice([*hashes, None])
        if h is not None:
            for b in rng.sample(range(62), rng.randrange(4)):
                h ^= 1 << b
        rows.append((i, rng.choice([None, "", *(f"http://x/{k}" for k in range(150))]), h, rng.choice([None, "", *(f"text {k}" for k in range(90))])))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    urls, stored, texts, want = set(), [], set(), {}
    for i, url, h, text in rows:
        if url and sha(url) in urls:
            want[i] = ("url", sha(url)[:8])
            continue
        urls.add(sha(url)) if url else None
        near = None if h is None else next((j for j, g in stored if (g ^ h).bit_count() <= 4), None)
        if near is not None:
            want[i] = ("phash", str(near))
            continue
        stored += [(i, h)] if h is not None else []
        if text and sha(text) in texts:
            want[i] = ("content", sha(text)[:8])
            continue
        texts.add(sha(text)) if text else None
        want[i] = (None, None)
    df = spark.createDataFrame(rows, "id long, url string, phash long, text string").repartition(5)
    got = L.dedup_posts(df).collect()
    assert {r["id"]: (r["signal"], r["canonical"]) for r in got} == want and len(got) == 400
    assert {s for s, _ in want.values()} == {"url", "phash", "content", None} and all(r["duplicate"] == (r["signal"] is not None) for r in got)
    assert L.dedup_posts(df.where("false")).count() == 0


def test_attribution_equals_all_pairs(spark):
    """Pairs without a common entity, held together by times, category and behaviour alone, are found too."""
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    when = lambda: t0 + timedelta(hours=rng.randrange(500)) if rng.random() < 0.7 else None
    rows = [(c, [rng.random(), rng.random()], rng.choice(["A", "B", "UNKNOWN"]), rng.choice(["", "SBI"]), rng.random() < 0.5, when(), when(), rng.randrange(4)) for c in range(40)]
    shared = sorted({(rng.randrange(40), k, str(rng.randrange(60))) for k in ("UPI", "PHONE", "URL", "IMAGE") for _ in range(40)})
    chans = spark.createDataFrame(rows, "channel long, vector array<double>, category string, impersonated string, promises boolean, taken_down timestamp, created timestamp, n_evidence long")
    ents = spark.createDataFrame(shared, "channel long, entity_type string, value string")
    weights = {"UPI": 0.4, "PHONE": 0.3, "URL": 0.2, "IMAGE": 0.1}

    def probability(a, b):
        infra = 0.0
        for k, w in weights.items():
            x, y = ({v for c, kind, v in shared if kind == k and c == d} for d in (a[0], b[0]))
            infra += w * len(x & y) / len(x | y) if x | y else 0.0
        cos = sum(p * q for p, q in zip(a[1], b[1])) / math.sqrt(sum(p * p for p in a[1]) * sum(q * q for q in b[1]))
        time = math.exp(-abs((b[6] - a[5]).total_seconds()) / 3600 / 48) if a[5] and b[6] else 0.0
        content = 0.4 * (a[2] == b[2] != "UNKNOWN") + 0.4 * (a[3] == b[3] != "") + 0.2 * (a[4] and b[4])
        return 1 / (1 + math.exp(-(-4 + 3 * infra + (cos + 1) / 2 + 2 * time + 0.5 * content + 1.5 * infra * time)))

    for least in (0.08, 0.2, 0.3):
        want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if round(probability(a, b), 4) >= least}
        got = {(r["a"], r["b"]) for r in L.attribution(chans, ents, least).collect()}
        assert got == want and len(want) > 1


def test_people_and_numbers(spark):
    df = spark.createDataFrame([("SRK and Big B endorse this", "+91 8312345678"), ("nobody", "12345"), (None, None)], "t string, p string")
    got = df.select(T.celebrities(F.col("t")).alias("who"), T.phone_profile(F.col("p")).alias("n"), T.celebrities(F.col("t"), T.people_with([("No Body", "X", ["nobody"])], ("ms dhoni",))).alias("more")).collect()
    assert [r["name"] for r in got[0]["who"]] == ["Amitabh Bachchan", "Shah Rukh Khan"] and got[1]["who"] == [] and [r["name"] for r in got[1]["more"]] == ["No Body"]
    assert tuple(got[0]["n"]) == ("Vi", "Vodafone Idea", "Bihar", "MOBILE", "High-risk telecom circle: Bihar (Jamtara belt)")
    assert got[1]["n"]["number_type"] == "UNKNOWN"
    names = {n for n, _, _ in T.people_with([("Ratan Tata", "Z", [])], ("MS Dhoni",))}
    assert len(names) == 15 and "MS Dhoni" not in names


def test_first_seen_cascade(spark):
    """p2 repeats the content of p1 under a new address and registers that address, so p3 repeats an address."""
    rows = [(1, "a", "T"), (2, "b", "T"), (3, "b", "U"), (4, None, "U"), (5, "", None), (6, "", None)]
    got = L.first_seen_cascade(spark.createDataFrame(rows, "id long, url string, content string"), ["url", "content"], "id").collect()
    assert {r["id"]: (r["reason"], r["canonical"]) for r in got} == {1: (None, None), 2: ("content", 1), 3: ("url", 2), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_identity(spark):
    rows = [("PHONE", "1", "a", 5), ("PHONE", "1", "b", 3), ("PHONE", "2", "a", 1), ("URL", "1", "a", 1), ("URL", "1", "b", 1)]
    got = L.identity_exact(spark.createDataFrame(rows, "entity_type string, value string, platform string, channel long")).collect()
    assert [(r["value"], r["probability"], r["operator"]) for r in got] == [("1", 0.9, "Operator via 3")]
    names = [("quick_money_12", "x"), ("QuickMoney", "y"), ("other", "y"), ("quick_money_99", "x")]
    fuzzy = L.identity_fuzzy(spark.createDataFrame(names, "name string, platform string")).collect()
    assert {(r["name_a"], r["name_b"]) for r in fuzzy} == {("QuickMoney", "quick_money_12"), ("QuickMoney", "quick_money_99")}
    assert all(r["probability"] == 0.85 for r in fuzzy)


def test_identity_fuzzy_loses_no_pair(spark):
    """Against all pairs: short handles, swapped and doubled letters, names of digits only, a long name, other scripts."""
    from vigilspark.functions.udfs import name_similarity

    rng = random.Random(11)
    names = ["priya", "pryia", "anita", "anyta", "abcd", "abed", "ab", "abc", "a", "b", "123", "45_", "", "x" * 70, "xy" * 30, "राहुल", "राहूल", "naïve", "Naive_1"]
    long = "".join(rng.choice("abcdefghij") for _ in range(60))
    names += [long, long[:25] + "zz" + long[30:], long[:35], long[:41], long[10:48]]
    names += ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    rows = [(n, rng.choice(["x", "y"])) for n in names] + [(None, "x"), ("abcd", "y"), ("abcd", "x")]
    held = sorted({r for r in rows if r[0] is not None})
    want = {(*a, *b) for i, a in enumerate(held) for b in held[i + 1 :] if a[1] != b[1] and name_similarity(a[0], b[0]) >= 0.7}
    got = [(r["name_a"], r["platform_a"], r["name_b"], r["platform_b"]) for r in L.identity_fuzzy(spark.createDataFrame(rows, "name string, platform string")).collect()]
    assert set(got) == want and len(got) == len(want)
    assert L.identity_fuzzy(spark.createDataFrame([], "name string, platform string")).count() == 0


def test_identity_clusters(spark):
    exact = spark.createDataFrame([("9", "a,b", 0.9)], "value string, platforms string, probability double")
    fuzzy = spark.createDataFrame(
        [("m", "a", "n", "b", 0.6), ("n", "a", "m", "b", 0.7), ("9", "a", "9", "b", 0.85)], "name_a string, platform_a string, name_b string, platform_b string, probability double"
    )
    got = {tuple(r["members"]): (r["source"], r["probability"]) for r in L.identity_clusters(exact, fuzzy).collect()}
    assert got == {("9",): ("EXACT", 0.9), ("m", "n"): ("FUZZY", 0.7)}


def test_nearest(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(100, None), (101, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = []
    for q in range(0, 60, 7):
        best = sorted((-round(cos(rows[q][1], v), 6), i) for i, v in rows[:60] if i != q)[:3]
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(best) if -s >= 0.2]
    for block in (4096, 4):
        assert sorted(map(tuple, nearest(df, df.where("id % 7 = 0 and id < 60"), 3, 0.2, block, 3).collect())) == sorted(want)
    assert nearest(df, df.where("false")).count() == 0


def test_host_blocklist(spark):
    urls = spark.createDataFrame([(1, "https://a.bad.example/x"), (2, "https://notbad.example"), (3, "http://bad.example")], "id long, url string")
    got = L.blocklist_hosts(urls, spark.createDataFrame([("bad.example",)], "domain string")).collect()
    assert sorted(r["id"] for r in got) == [1, 3]


def test_evaluation(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.4, rng.randrange(50) / 50) for _ in range(400)] + [(True, 1.0)]
    df = spark.createDataFrame(rows, "actual boolean, score double")
    pos, neg = [s for a, s in rows if a], [s for a, s in rows if not a]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert E.roc_auc(df).first()["auc"] == pytest.approx(auc, abs=1e-6)
    b = E.binary_metrics(df, 0.5).first()
    assert (b["tp"], b["fp"]) == (sum(s >= 0.5 for s in pos), sum(s >= 0.5 for s in neg))
    sweep = {r["t"]: r for r in E.threshold_sweep(df).collect()}
    assert sweep[50]["tp"] == b["tp"] and sweep[50]["f1"] == b["f1"] and len(sweep) == 90


def test_chain_verification(spark):
    rows = [("c", 1, "h1", "GENESIS"), ("c", 2, "h2", "h1"), ("c", 3, "h3", "x"), ("d", 1, "k", "GENESIS")]
    got = {r["chain"]: (r["valid"], r["first_broken"]) for r in verify_chains(spark.createDataFrame(rows, "chain string, line int, this_hash string, prev_hash string")).collect()}
    assert got == {"c": (False, 3), "d": (True, None)}


def test_case_filters(spark):
    rows = [(1, "PENDING", "50% off", datetime(2024, 1, 1)), (2, "APPROVED", "plain", datetime(2024, 2, 1)), (3, "PENDING", None, datetime(2024, 3, 1))]
    df = spark.createDataFrame(rows, "case_id long, status string, notes string, created_at timestamp")
    ids = lambda d: sorted(r["case_id"] for r in d.collect())
    assert ids(C.filter_cases(df, status="PENDING", date_from="2024-02-01")) == [3]
    assert ids(C.filter_cases(df, search="50%")) == [1] and ids(C.search_columns(df, "PEND", ["status", "notes"])) == [1, 3]
    assert ids(C.page(df, [F.desc("created_at")], 2, 2)) == [1]
    assert ids(C.latest_per_key(df, ["status"], [F.desc("created_at")])) == [2, 3]


def test_siamese(spark):
    from vigilspark.operators import siamese

    rng = np.random.default_rng(0)
    layers = [(rng.standard_normal((3, 2)), np.zeros(3)), (rng.standard_normal((2, 3)), np.ones(2))]
    df = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0], 0.0), ([1.0, 2.0], [1.0, 2.0], 1.0)], "vector_a array<double>, vector_b array<double>, label double")
    got = [r["similarity"] for r in siamese.similarity(df, layers).collect()]
    x, y = (siamese.encode(np.array([v]), layers)[0] for v in ([1.0, 2.0], [2.0, 1.0]))
    assert got == [pytest.approx((x @ y / np.linalg.norm(x) / np.linalg.norm(y) + 1) / 2), pytest.approx(1.0)]
    noisy = siamese.augment(df, 300)
    shift = np.array([r["vector_a"] for r in noisy.collect()]) - [1.0, 2.0]
    assert noisy.count() == 600 and abs(shift.mean()) < 0.005 and 0.025 < shift.std() < 0.035
    model = siamese.fit_native(noisy)
    assert model.numFeatures == 2


def test_intent_and_rules(spark):
    from vigilspark.functions import text as T

    def run(fn, *values):
        return one(spark, fn(*[F.lit(v) for v in values]))

    assert run(T.intent, "mukesh ambani invest for profit")["category"] == "CELEBRITY_INVESTMENT_SCAM"
    assert run(T.intent, "hello")["category"] == "GENERIC_CONTENT" and run(T.intent, "police station")["confidence"] == pytest.approx(0.6)
    assert run(T.use_case, "digital arrest") == "DIGITAL_ARREST" and run(T.use_case, "nothing") == "OTHER"
    assert run(T.investment_claim, "we say: earn daily") == "earn daily"
    assert run(T.reach_estimate, 3, 0, 0) == "MEDIUM" and run(T.reach_estimate, 0, 1, 0) == "HIGH"
    assert run(T.domain_risk, "win-money.example", 10, True, "US") == 90
    assert run(T.ocr_postfix, "call  +91 9876543211  pay a @ ybl https : / / x.y") == "call +91-9876543211 pay a@ybl https:// x.y"
    assert run(T.image_type, 2.0, 10, 10, 500, 0, 0, 0.0, 0.0, 0) == "SCREENSHOT"


def test_freeze_requests(spark):
    d = lambda k: datetime(2024, 1, k)
    rows = [
        ("r1", "a@ybl", "CREATE", None, None, d(2)), ("r1", None, "SUBMIT", True, "early", d(1)), ("r1", None, "SUBMIT", False, None, d(3)), ("r1", None, "SUBMIT", True, "ok", d(4)),
        ("r2", "b@ybl", "CREATE", None, None, d(2)), ("r3", "c@ybl", "CREATE", None, None, d(2)), ("r3", None, "SUBMIT", False, None, d(2)), ("r4", None, "SUBMIT", True, "x", d(2)),
    ]
    events = spark.createDataFrame(rows, "request_id string, upi string, kind string, accepted boolean, reference string, ts timestamp")
    got = {r["request_id"]: (r["status"], r["reference"], r["refused"]) for r in I.freeze_requests(events).collect()}
    assert got == {"r1": ("SUBMITTED", "ok", 1), "r2": ("PENDING", "", 0), "r3": ("REJECTED", "", 0), "r4": ("NOT_FOUND", "", 1)}
    assert I.freeze_requests(events.where("false")).count() == 0


def test_content_marks(spark):
    rows = [(1, 2, "Double your"), (1, 1, "SBI account blocked, call now"), (1, 3, "money"), (2, 1, "sbi results are out"), (3, 1, None)]
    got = {r["channel"]: (r["impersonated"], r["promise"], r["category"]) for r in I.content_marks(spark.createDataFrame(rows, "channel long, message_id long, text string")).collect()}
    assert got == {1: ("State Bank of India", "double your money", "UNKNOWN"), 2: ("", "", "UNKNOWN"), 3: ("", "", "UNKNOWN")}


def test_phone_formats_are_searched_once(spark):
    plan = spark.range(3).select(T.phone_numbers(F.col("id").cast("string")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("wa\\.me") == 1


def test_phone_numbers(spark):
    """The standard pattern takes a country code, so it also finds the number of a chat link, and comes first."""
    from vigilspark.functions import text as T

    got = one(spark, T.phone_numbers(F.lit("9876543210 wa.me/919876543210 wa.me/918888888888 and 98+OO+12+34+56"), F.array(F.lit("9000000001"), F.lit("8888888888"))))
    assert [(p["normalized"], p["format_type"], p["confidence"]) for p in got] == [
        ("+91-9876543210", "STANDARD", 1.0), ("+91-8888888888", "STANDARD", 1.0), ("+91-9800123456", "DISGUISED", 0.7), ("+91-9000000001", "WORD_FORM", 0.6),
    ]
    assert one(spark, T.sms_text(F.lit("HIGH"), F.lit("c"), F.lit("t" * 99), F.lit("a" * 99))) == "[HIGH] c\n" + "t" * 80 + "\nAction: " + "a" * 60
    assert one(spark, T.campaign_name(F.lit("lottery in NOIDA"))) == "Lottery Scam Network — Noida"


def test_checksum_of_many_edges_does_not_overflow(spark):
    from vigilspark.operators.components import _fingerprint

    edges = spark.range(2_500_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert _fingerprint(edges)[0] == 2_500_000 and _fingerprint(edges) != _fingerprint(edges.where("a <> 7"))


def test_values_met_are_shared_or_listed_in_one_join(spark):
    points = spark.createDataFrame([(1, "UPI", "a"), (2, "UPI", "a"), (3, "UPI", "b"), (4, "URL", "a"), (5, "UPI", None)], "channel long, entity_type string, value string")
    blocked = spark.createDataFrame([("UPI", "b"), ("UPI", "b"), ("UPI", "a"), ("PHONE", "z"), ("UPI", None)], "entity_type string, value string")
    met = L.values_met(points, blocked)
    assert sorted(map(tuple, met.collect())) == [(1, "UPI", "a", 2, 1), (2, "UPI", "a", 2, 1), (3, "UPI", "b", 1, 2)]
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    features = spark.createDataFrame([], "channel long, deletion_rate double, backup_mentions long, urgency_share double")
    content = spark.createDataFrame([], "channel long, impersonated string, promise string, category string")
    items = [(r["channel"], r["evidence_type"], r["strength"]) for r in I.evidence_items(met, features, content).collect()]
    listed, shared = ("BLOCKLIST_MATCH", "DEFINITIVE"), ("SHARED_ENTITY", "MODERATE")
    assert sorted(items) == [(1, *listed), (1, *shared), (2, *listed), (2, *shared), (3, *listed), (3, *listed)]


def test_rule_category_counts_in_generated_code(spark):
    texts = ["betting tips, cricket prediction", "ponzi, zero risk; betting tips, cricket prediction", "ponzi", "", None]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", T.rule_category(F.col("text")).alias("c"))
    assert [r["c"] for r in found.orderBy("k").collect()] == ["BETTING_SCAM", "INVESTMENT_SCAM", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_confidence_makes_sets_of_counted_sources(spark):
    channels = spark.createDataFrame([(1, 7, 200)], "channel long, populated int, n_posts long")
    items = spark.createDataFrame([(1, "x", "s1", "v", "WEAK"), (1, "x", "s1", "w", "WEAK"), (1, "y", "s2", "v", "STRONG")], "channel long, evidence_type string, source string, value string, strength string")
    found = I.confidence(channels, items)
    row = found.first()
    assert (row["n_items"], row["sources"], row["rank"], row["agreement"]) == (3, 2, 4, 0.6667)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3  # by source, by strength, by channel


def test_texts_are_searched_once_for_campaigns(spark, monkeypatch):
    from vigilspark.plans import link_plans as P

    searched, search = [], P.post_entities
    monkeypatch.setattr(P, "post_entities", lambda *a: searched.append(a) or search(*a))
    plan = P.campaign_rollup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(searched) == 1 and "regexp_extract_all" not in plan


def test_new_channels_of_a_day_are_counted_by_search():
    import time
    from datetime import timezone

    from vigilspark.streaming.stateful import Alerts

    class State(dict):
        exists = lambda self: bool(self)
        update = lambda self, v: None
        iterator = lambda self: iter(self.items())
        updateValue = lambda self, k, v: dict.update(self, {k: v})  # noqa: E731, N815
        removeKey = lambda self, k: self.pop(k)  # noqa: E731, N815

    p = Alerts({"new_channels_24h": 20_001, "estimated_reach": 1e18, "platforms": 9})
    p.facts, p.recent, p.platforms, p.active, p.holding = (State() for _ in range(5))
    begun = datetime(2024, 1, 1, tzinfo=timezone.utc)
    row = lambda k: {"id": k, "channel": k, "platform": None, "reach": 0.0, "ts": begun + timedelta(seconds=4 * k), "alert_id": None}
    at = time.process_time()
    made = list(p.handleInputRows((1,), iter([row(k) for k in range(40_000)]), None))
    assert time.process_time() - at < 8  # a pass over all channels for each post takes far longer
    # a day holds 21,600 posts four seconds apart, so the 20,001st new channel raises once
    assert [(r["alert_type"], r["value"], r["ts"]) for r in made] == [("NEW_CAMPAIGN", 1.0, begun), ("RAPID_GROWTH", 20_001.0, begun + timedelta(seconds=80_000))]


def test_letters_codes_and_emoji_are_counted_only_where_they_can_be(spark):
    from vigilspark.functions import fixed as X

    texts = ["plain ASCII", "naïve café", "जल्दी करो now", "जल्दी", "12 !", "", None, "scan the code, QR Code, qr", "qrs and scans", "ok 😀😀 then 🚀", "é"]
    t = F.col("text")
    made = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").select(
        "k", T.script_share(t).alias("share"), T.code_mentions(t).alias("codes"), T.emoji_runs(t, X.EMOJI).alias("emoji"), T.shows_code(t).alias("shows"),
    )
    rows = made.orderBy("k").collect()
    assert [None if r["share"] is None else round(r["share"], 2) for r in rows] == [0.0, 0.0, 0.73, 1.0, None, None, None, 0.0, 0.0, 0.0, None]
    assert [r["codes"] for r in rows] == [0, 0, 0, 0, 0, 0, None, 3, 0, 0, 0] and [r["emoji"] for r in rows] == [0, 0, 0, 0, 0, 0, None, 0, 0, 2, 0]
    assert [r["shows"] for r in rows] == [k == 7 for k in range(len(texts))]


def test_marks_of_all_posts_in_chunks(spark):
    """Cut into chunks, the text of a channel has the marks of the whole text, also across the borders of posts and chunks."""
    rng = random.Random(5)
    said = ["sbi account", "blocked, call now", "double your", "money", "", None, " \n", "guaranteed", "return 20%", "profit", "betting", "tips", "zero", "risk", "ponzi", "digital", "arrest"] + ["nothing"] * 12
    rows = [(c, m, rng.choice(said)) for c in range(25) for m in range(rng.randrange(1, 60))]
    rows += [(99, m, "nothing") for m in range(230)] + [(99, 230, "double"), (99, 231, "money"), (99, 232, "zero risk ponzi")]
    texts = spark.createDataFrame(rows, "channel long, message_id long, text string")
    want = sorted(map(tuple, I.content_marks(texts, first=10**6).collect()))
    assert sorted(map(tuple, I.content_marks_whole(texts).collect())) == want
    assert sorted(map(tuple, I.content_marks_whole(texts, chunk=9, ahead=8).collect())) == want
    assert (99, "", "double money", "INVESTMENT_SCAM") in want and len({w[1:] for w in want}) > 5


def _many_orders(tmp_path):
    """The smallest tables, with orders of two customers: 150 that name a backup, and 230 whose last ones name an arrest."""
    import os

    import pandas as pd

    small = "/root/testdata/sf0.001"
    for name in os.listdir(small):
        if name != "orders.parquet":
            os.symlink(f"{small}/{name}", tmp_path / name)
    keys = [7 * k for k in range(150)] + [7 * k + 3 for k in range(200, 425)] + [7 * k + 6 for k in range(500, 505)]
    orders = pd.read_parquet(f"{small}/orders.parquet").iloc[[0] * len(keys)].assign(o_orderkey=keys, o_custkey=[90_009] * 150 + [90_013] * 230)
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    return str(tmp_path)


def test_evidence_reads_all_texts(spark, tmp_path):
    import __spark_entry__ as entry

    rows = entry.queries()["evidence_items"](spark, _many_orders(tmp_path)).where("channel > 90000").collect()
    got = {(r["channel"], r["evidence_type"]): r["value"] for r in rows}
    assert got[90_009, "BACKUP_CHANNEL_MENTION"] == "150" and got[90_013, "IMPERSONATION_DETECTED"] == "Central Bureau of Investigation"


def test_queue_reads_all_texts(spark):
    from vigilspark.plans.more_plans import recommendation_queue

    plan = recommendation_queue(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 100)" not in plan and "<= 200)" not in plan and "chunk" in plan


def test_all_near_pairs_of_copies(spark):
    """Copies are paired with each other and with all copies of near hashes, in blocks of any size."""
    rng = random.Random(8)
    hashes = [h ^ x for h in (rng.getrandbits(63) for _ in range(6)) for x in (0, 0, 0, 1, 1, 6, 7 << 20)] * 3
    rng.shuffle(hashes)
    rows = spark.createDataFrame([*enumerate(hashes), (None, hashes[0]), (999, None)], "id long, phash long")
    want = sorted((i, j, (a ^ b).bit_count()) for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 4)
    for block in (2, 1024):
        assert sorted(map(tuple, L.phash_all_pairs(rows, block=block).collect())) == want


def test_phash_query_pairs_copies(spark, tmp_path, monkeypatch):
    from vigilspark.plans import link_plans as P

    monkeypatch.setattr(P, "image_hashes", lambda *a: spark.createDataFrame([(1, 7), (2, 7), (3, 7), (9, 6), (8, 6)], "id long, phash long"))
    got = sorted(map(tuple, P.phash_pairs(spark, "").collect()))
    assert got == [(1, 2, 0), (1, 3, 0), (1, 8, 1), (1, 9, 1), (2, 3, 0), (2, 8, 1), (2, 9, 1), (3, 8, 1), (3, 9, 1), (8, 9, 0)]


@pytest.mark.parametrize("ids", ["near", "far", "text"])
def test_jaccard_counts_in_blocks(spark, ids):
    """Pairs are counted where their lists are and not shuffled; blocks by number, by hash where numbers crowd, and of texts give the same."""
    rng = random.Random(4)
    name = {"near": lambda c: c - 7, "far": lambda c: c if c else 2**62, "text": lambda c: f"c{c:02d}"}[ids]
    rows = [(name(rng.randrange(60)), rng.choice(["UPI", "PHONE", "URL", "IMAGE", "QR"]), rng.choice("abcdefghijkl")) for _ in range(500)] + [(name(1), "UPI", None), (name(2), "UPI", None), (None, "UPI", "a")]
    got = L.jaccard_by_type(spark.createDataFrame(rows, f"channel {'string' if ids == 'text' else 'long'}, entity_type string, value string"), held=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(a#" not in plan and "Exchange hashpartitioning(block#" in plan and "SortMergeJoin" not in plan
    sets = {}
    for c, k, v in set(rows):
        sets.setdefault(c, {}).setdefault(k, set()).add((k, v))
    sets.pop(None)
    want = []
    for a in sets:
        for b in sets:
            both = {k: {x for x in sets[a].get(k, set()) & sets[b].get(k, set()) if x[1]} for k in ("UPI", "PHONE", "URL", "IMAGE", "QR")}
            if a < b and any(both.values()):
                union = lambda k: len(sets[a].get(k, ())) + len(sets[b].get(k, ())) - len(both[k])
                want.append((a, b, *[pytest.approx(len(both[k]) / union(k)) if both[k] else 0.0 for k in L.JACCARD_KINDS]))
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda w: w[:2])


def test_sharing_pairs_are_not_shuffled(spark):
    """Up to the bound of channels, pairs that share an entity meet both channels where they are; beyond it they are exchanged."""
    t = datetime(2024, 1, 1)
    rows = [(c, [1.0, c / 9] if c < 5 else [1.0], "A", "", True, t, t + timedelta(hours=c), 1) for c in range(12)]
    chans = spark.createDataFrame(rows, "channel long, vector array<double>, category string, impersonated string, promises boolean, taken_down timestamp, created timestamp, n_evidence long")
    ents = spark.createDataFrame([(c, "UPI", str(c // 4)) for c in range(12)], "channel long, entity_type string, value string")
    few = [sorted(map(tuple, L.attribution(rows, ents, 0.08).collect())) for rows in (chans.where("channel < 5"), chans)]
    plan = L.attribution(chans, ents, 0.08)._jdf.queryExecution().executedPlan().toString().split("known", 1)[0]
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    before, L.FEW = L.FEW, 3
    try:
        assert [sorted(map(tuple, L.attribution(rows, ents, 0.08).collect())) for rows in (chans.where("channel < 5"), chans)] == few
    finally:
        L.FEW = before
    assert len(few[1]) > len(few[0]) > 0


def test_operator_components_without_their_pairs(spark, monkeypatch):
    """Components of all attribution pairs, of which only few edges are kept; pivots need not find any."""
    from vigilspark.operators.components import connected_components

    t = datetime(2024, 1, 1)
    rows = [(c, [1.0, float(c % 5)], "AB"[c % 2], "", True, t + timedelta(days=40 * (c % 7)) if c % 3 else None, t + timedelta(days=40 * (c % 7), hours=2), 1) for c in range(90)]
    chans = spark.createDataFrame(rows, "channel long, vector array<double>, category string, impersonated string, promises boolean, taken_down timestamp, created timestamp, n_evidence long")
    ents = spark.createDataFrame([(c, "UPI", str(c // 2)) for c in range(80, 84)] + [(3, "PHONE", "p"), (82, "PHONE", "p")], "channel long, entity_type string, value string")
    pairs = [tuple(r) for r in L.attribution(chans, ents, 0.1).select("a", "b").collect()]
    want = sorted(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()))
    kept = []
    monkeypatch.setattr(L, "connected_components", lambda edges, *on: kept.append(edges.count()) or connected_components(edges, *on))
    for pivots in (0, 16):
        assert sorted(map(tuple, L.operator_components(chans, ents, 0.1, pivots).collect())) == want
    assert len({c for _, c in want}) > 3 and kept[-1] < len(pairs)
    edges = spark.range(0, 2000, 1, 1).select((F.col("id") % 50).alias("a"), (F.col("id") % 50 + 1 + F.col("id") % 3).alias("b"))
    assert L.spanning(edges).count() == 52
