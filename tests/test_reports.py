"""Assembled texts, masked records, advisory readers and the sinks and feeds beside them."""

import glob
import json
import re

from pyspark.sql import functions as F

from vigilspark.functions import fixed as X
from vigilspark.functions import reports as R
from vigilspark.sources import advisories as A
from vigilspark.sources import files


def plain_indicators(text, category):
    """Indicators by plain loops over one text."""
    for cid, *_, english, hindi in X.CATEGORIES:
        if cid == category:
            found = [f"Contains '{w}' (English keyword match)" for w in english if w.lower() in text.lower()][:5]
            found = (found + [f"Contains '{w}' (Hindi keyword match)" for w in hindi if w in text])[:8]
            return (found + [s for p, s in X.GENERAL_INDICATORS if re.search(p, text)])[:10]
    return []


def test_keyword_indicators(spark):
    cid, *_, english, hindi = X.CATEGORIES[0]
    texts = [" ".join(english + hindi) + " wa.me/1 a@b ₹5", english[0].upper() + " Rs 5", hindi[0], "nothing", "", None]
    rows = [(k, t, c) for k, (t, c) in enumerate([(t, cid) for t in texts] + [(texts[0], "unknown"), (texts[0], None)])]
    got = {r["k"]: r["i"] for r in spark.createDataFrame(rows, "k int, text string, c string").select("k", R.keyword_indicators(F.col("text"), F.col("c")).alias("i")).collect()}
    assert got == {k: (plain_indicators(t, c) if t is not None else []) for k, t, c in rows}
    assert len(got[0]) == 10 and len(got[1]) == 2


def test_explanation(spark):
    cid, label, group, severity, priority, law = X.CATEGORIES[1][:6]
    rows = [(1, cid, [f"i{k}" for k in range(7)], "Other", 1, 0), (2, cid, [], "", 0, 0), (3, "unknown", ["x"], "", 1, 1), (4, None, [], "", 0, 0)]
    df = spark.createDataFrame(rows, "k int, c string, i array<string>, s string, p int, u int")
    got = {r["k"]: r["e"] for r in df.select("k", R.explanation(*[F.col(c) for c in "cispu"]).alias("e")).collect()}
    head = f"This content has been classified as **{label}** under the {group.replace('_', ' ')} category."
    tail = f"\n\nApplicable law: {law}\nSeverity: {severity}\nBlocking priority: {priority}/5"
    bullets = "\n".join(f"  • i{k}" for k in range(5))
    assert got[1] == f"{head}\n\n\nKey indicators found (7):\n{bullets}\n\n\nAlso related to: Other\n{tail}\n\n\nEntities detected: 1 phone(s), 0 UPI ID(s)"
    assert got[2] == f"{head}\n{tail}" and got[3] == got[4] == "Unable to classify content."


def test_sections_and_summaries(spark):
    schema = "p struct<act: string, section: string>, more array<struct<act: string, section: string>>, ev array<string>"
    df = spark.createDataFrame([(("IT Act", "66D"), [("IPC", "420"), None], ["a", "b", "c", "d"]), (("IT Act", "67"), None, [])], schema)
    rows = df.select(
        R.section_strings(F.col("p"), F.col("more")).alias("s"), R.identity_summary(F.lit(0.876), F.lit(""), F.array(F.lit("x"), F.lit("y")), F.col("ev")).alias("i"),
        R.role_line(F.lit("ann"), F.lit("ADMIN"), F.lit(0.5), F.col("ev")).alias("r"),
    ).collect()
    assert [r["s"] for r in rows] == [["IT Act 66D", "IPC 420"], ["IT Act 67"]]
    assert rows[0]["i"] == "Identity Cluster — 88% probability\nOperator: Unknown\nPlatforms: x, y\nEvidence:\n  • a\n  • b\n  • c\n  • d"
    assert [r["r"] for r in rows] == ["  @ann: ADMIN (confidence=50%)\n    • a\n    • b\n    • c", "  @ann: ADMIN (confidence=50%)"]


def test_masked_records(spark):
    schema = "id long, msg string, args array<string>, extra map<string, string>, who struct<name: string, n: int>, `a.b` string, kept string"
    phone, mail = "9876543210", "x@ybl"
    rows = [(1, f"call {phone}", [phone, None, "ok"], {phone: mail}, (mail, 5), phone, phone), (2, None, None, None, None, None, None)]
    got = R.masked(spark.createDataFrame(rows, schema), keep=("kept",)).orderBy("id").collect()
    one = got[0]
    assert (one["id"], one["msg"], one["args"], one["kept"]) == (1, "call ***PHONE***", ["***PHONE***", None, "ok"], phone)
    assert one["extra"] == {phone: "***UPI***"} and tuple(one["who"]) == ("***UPI***", 5) and one["a.b"] == "***PHONE***"
    assert tuple(got[1]) == (2, None, None, None, None, None, None)


TEXTS = "source_url string, idx long, text string"


def test_advisories(spark):
    many = "Title line \nfraud " + " ".join(f"https://a{k}.com/x" for k in range(60)) + " www.cert-in.org t.me/one https://t.me/two " + "IT Act Section 66D, " * 7
    rows = [("u", 1, many), ("u", 2, "  " + "x" * 29 + "\n"), ("u", 3, "x" * 30), ("u", 12_345, "y" * 5_000), ("u", 5, None), ("u", 6, "")]
    got = {r["advisory_id"]: r for r in A.advisories(spark.createDataFrame(rows, TEXTS)).collect()}
    assert sorted(got) == ["I4C-ADV-0001", "I4C-ADV-0003", "I4C-ADV-12345"]
    one = got["I4C-ADV-0001"]
    assert (one["title"], len(one["blocked_urls"]), len(one["blocked_domains"]), one["blocked_channels"]) == ("Title line", 50, 50, ["t.me/one", "two"])  # a link without scheme stays
    assert one["it_act_section"] == "; ".join(["IT Act Section 66D"] * 5) and (len(got["I4C-ADV-12345"]["title"]), len(got["I4C-ADV-12345"]["content"])) == (150, 3_000)
    entries = A.advisory_entities(A.advisories(spark.createDataFrame(rows, TEXTS)))
    assert {r["entity_type"]: r["count"] for r in entries.groupBy("entity_type").count().collect()} == {"URL": 50, "DOMAIN": 50, "CHANNEL": 2}


def test_alerts(spark):
    text = " ".join(f"h{k:02d}.com 10.0.0.{k} a{k:02d}@ybl CVE-2024-{1000 + k} https://u{k:02d}.in/" for k in range(60)) + " x.nic.in urgent"
    rows = [("u", 1, text + " " + text), ("u", 2, "x" * 19), ("u", 3, " " + "x" * 20), ("u", 4, None)]
    got = {r["alert_id"]: r for r in A.alerts(spark.createDataFrame(rows, TEXTS)).collect()}
    assert sorted(got) == ["CERTIN-0001", "CERTIN-0003"]
    one = got["CERTIN-0001"]
    assert [len(one[c]) for c in ("domains", "ips", "upis", "cves", "infrastructure")] == [50, 50, 20, 10, 50]
    assert one["severity"] == "CRITICAL" and one["domains"] == sorted(one["domains"]) and not any("nic.in" in d for d in one["domains"])


def test_one_file_a_channel(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 5).cast("string").alias("channel"), "id").repartition(8)
    files.write_by_channel(df, str(tmp_path / "one"))
    assert all(len(glob.glob(f"{tmp_path}/one/channel={k}/*.json")) == 1 for k in range(5))
    assert files.read_by_channel(spark, str(tmp_path / "one"), "channel string, id long").distinct().count() == 400


def test_hot_channel_has_many_writers(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "64k")
    try:
        rows = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 9).cast("string")).alias("channel"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        files.write_by_channel(rows, str(tmp_path / "hot"))
    finally:
        spark.conf.set(size, before)
    assert len(glob.glob(f"{tmp_path}/hot/channel=hot/*.json")) > 3
    assert spark.read.json(str(tmp_path / "hot")).count() == 60_000


def test_feed_begins_anew(spark):
    feed, none = spark.range(10), spark.range(0)
    batch, again = files.next_batch_or_reset(feed, spark.range(7), "id", 5)
    assert sorted(r["id"] for r in batch.collect()) == [7, 8, 9] and not again
    batch, again = files.next_batch_or_reset(feed, feed, "id", 4)
    assert batch.count() == 4 and again
    assert files.next_batch_or_reset(none, none, "id", 4)[0].count() == 0


def test_image_folder_and_reports(spark, tmp_path):
    for split, label, name in (("train", "real", "a.JPG"), ("train", "fake", "b.png"), ("val", "fake", "c.webp"), ("val", "fake", "note.txt")):
        (tmp_path / "img" / split / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / split / label / name).write_bytes(name.encode())
    found = files.image_folder(spark, str(tmp_path / "img")).collect()
    assert sorted((r["split"], r["label"]) for r in found) == [("train", "fake"), ("train", "real"), ("val", "fake")] and all(len(r["sha256"]) == 64 for r in found)
    paths = []
    for model in ("one", "two"):
        paths.append(str(tmp_path / f"{model}.json"))
        with open(paths[-1], "w") as f:
            f.write("\n".join(json.dumps({"model": model, "metric": m, "value": v}) for m, v in (("f1", 0.5), ("auc", 0.75))))
    assert sorted(tuple(r) for r in files.evaluation_reports(spark, *paths).collect()) == [("one", "auc", 0.75), ("one", "f1", 0.5), ("two", "auc", 0.75), ("two", "f1", 0.5)]
