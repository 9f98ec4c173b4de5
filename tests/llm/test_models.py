import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ROWS, clashing, docs
from vigilspark.llm import lang_id, quality, queries
from vigilspark.llm.common import crc_fold, crc_remainder
from vigilspark.llm.lm import FREQUENCY_BUCKETS, LEAST_BLOCKS, interpolated_scores, learn_weights, pack, pack_keys, unpack, unpack_keys

SF = "/root/testdata/sf0.01"


def test_crc_fold(spark):
    got = spark.range(50).select("id", crc_remainder("id", 7).alias("r")).collect()
    assert all(r["r"] == crc_fold(r["id"], 7) for r in got)


def test_language_accuracy_held_out(spark):
    from vigilspark.llm.queries import op5_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op5_language_id(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and 250 < len(held) < 420
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_backoff_and_awkward_rows(spark):
    train = docs(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate([("the house the garden", "en"), ("das haus der garten", "de")] * 5)])
    model = lang_id.fit(train)
    assert (model.found(0, ["house", "houses"]) >= 0).tolist() == [True, False]
    assert [model.langs[k] for k in model.word_scores(["houses", "gartens"]).argmax(axis=1)] == ["en", "de"]
    got = {r["doc_id"]: r for r in lang_id.predict(clashing(spark), model).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[10]["lang_pred"] == "und" and got[10]["score"] == 0
    assert got[1]["lang_pred"] == "en"
    assert lang_id.predict(docs(spark, []), model).count() == 0
    kept = lang_id.keep_identified(docs(spark), model)
    assert kept.columns == docs(spark).columns and 1 in {r["doc_id"] for r in kept.collect()}
    nothing = lang_id.fit(docs(spark, []))
    assert {r["lang_pred"] for r in lang_id.predict(docs(spark), nothing).collect()} == {"und"}


def test_quality_held_out(spark):
    from vigilspark.llm.queries import op10_quality

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in op10_quality(spark, SF).collect()]
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.97
    assert np.mean([p == y for _, p, y in held]) > 0.95


def test_quality_awkward_rows(spark):
    rows = docs(spark).withColumn("quality", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") == 1, 0))
    w = quality.fit(rows, buckets=1 << 12)
    got = quality.score(clashing(spark), w).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs(spark, []), w).count() == 0
    empty = quality.fit(rows.where("false"), buckets=1 << 12)
    assert {r["score"] for r in quality.score(docs(spark), empty).collect()} == {0.5}


def test_ftrl_sparse_and_separating():
    model = quality.Ftrl(64)
    for _ in range(50):
        model.learn(np.array([0, 5]), np.array([1.0, 1.0]), 1.0)
        model.learn(np.array([0, 9]), np.array([1.0, 1.0]), 0.0)
    w = model.weights()
    assert w[5] > 0.5 > -0.5 > w[9] and np.count_nonzero(w) <= 3


def brute_lm(rows, train):
    words = lambda t: [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + ["</s>"]
    c = Counter(w for (i, t, *_), keep in zip(rows, train) if keep for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t, *_ in rows]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_base_scores_equal_brute_force(spark, order):
    rng = random.Random(2)
    rows = [r for r in ROWS if r[0] != 9] + [(100 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(60))), "en", "s") for k in range(80)]
    train = [i is None or crc_fold(i, 7) != 2 for i, *_ in rows]
    got = interpolated_scores(docs(spark, rows), crc_remainder("doc_id", 7) != 2, order=order, block_bytes=20_000).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(got, key=key), sorted(brute_lm(rows, train), key=key), strict=True):
        assert tuple(g[:4]) == w[:4] and g[4] == pytest.approx(w[4], rel=1e-12)
        assert g["score"] < 0 and math.isfinite(g["score"])


def test_probabilities_sum_to_one_and_beat_the_base(spark):
    """Over every possible next word the interpolated bigram sums to one less the unseen share."""
    rng = random.Random(4)
    def sentence():
        out, w = [], "a"
        for _ in range(40):
            w = {"a": "b", "b": "c", "c": "a"}[w] if rng.random() < 0.9 else rng.choice("abc")
            out.append(w)
        return " ".join(out)
    rows = [(k, sentence(), "en", "s") for k in range(300)]
    df = docs(spark, rows)
    held = crc_remainder("doc_id", 7) == 2
    got = interpolated_scores(df, ~held).collect()
    out = [(g["score"], g["base_score"]) for g in got if crc_fold(g["doc_id"], 7) == 2]
    assert sum(s for s, _ in out) > sum(b for _, b in out) * 0.75
    again = interpolated_scores(df, ~held).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_repeats_empty_and_clashing(spark):
    twice = [(1, "a b a", None, None), (1, "a b a", None, None), (2, "c", None, None)]
    got = sorted(tuple(r) for r in interpolated_scores(docs(spark, twice), F.lit(True)).collect())
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 4, 10), (1, 4, 10), (2, 2, 10)] and got[0] == got[1]
    assert interpolated_scores(docs(spark, []), F.lit(True)).count() == 0
    assert interpolated_scores(clashing(spark), F.lit(True)).count() == len(ROWS)
    none = interpolated_scores(docs(spark, twice), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    p = 10.0 ** (-rng.integers(0, 29, size=(400, 2)) / 10)
    events = np.rint(1e6 * (0.3 * p[:, 0] + 0.7 * p[:, 1]) / 400).astype(int) + 1
    w = learn_weights(np.full(400, 3), events, p, 1000)
    assert w.shape[1] == 3 and np.allclose(w.sum(axis=1), 1)
    none = np.empty(0, np.int64)
    assert np.allclose(learn_weights(none, none, np.empty((0, 2)), 5), 1 / 3)


def test_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    counts = np.arange(keys.size) ** 2
    assert np.array_equal(unpack_keys(pack_keys(keys), keys.size), keys)
    assert np.array_equal(unpack(pack(counts), keys.size), counts)


def test_weights_are_learned_from_every_block(spark):
    """Training documents in none of the blocks 0 and 4 inform the weights too."""
    rows = docs(spark, [(k, "a b c d " * (3 + k % 5), "en", "s") for k in range(80)])
    rows = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(0).cast("long")), F.lit(LEAST_BLOCKS)) % 4 != 0)
    equal = np.full((FREQUENCY_BUCKETS, 4), 1 / 4)
    total = lambda **kw: sum(r["score"] for r in interpolated_scores(rows, F.lit(True), order=3, **kw).collect())
    assert rows.count() > 20 and total() > 0.9 * total(weights=equal)


def test_registered_model_has_order_3(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    want = {r["doc_id"]: r["score"] for r in interpolated_scores(table, ~held, order=3).collect()}
    got = {r["doc_id"]: r["score"] for r in queries.op9_lm_scores(spark, sf).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def brute_learned(rows, train, order, blocks):
    """Deleted interpolation on dictionaries: EM on every training token's exact estimates without its block's counts."""
    texts = [[*t.lower().split(), "</s>"] for _, t, *_ in rows]

    def ngrams(words, k):
        padded = ["<s>", *words]
        return [tuple(padded[max(0, i + 1 - k) : i + 2]) for i in range(len(words))]

    grams = [[ngrams(w, k) for w in texts] for k in range(order)]
    whole = [Counter(g for d, keep in zip(grams[k], train) if keep for g in d) for k in range(order)]
    n, v, documents = sum(whole[0].values()), len(whole[0]), sum(train)

    def tokens_of(d, deleted=None, gone=0, gone_documents=0):
        left = (lambda k, g: whole[k][g] - deleted[k][g]) if deleted else (lambda k, g: whole[k][g])
        for i in range(len(texts[d])):
            estimate, context = [left(0, grams[0][d][i]) / max(n - gone, 1)], n - gone
            for k in range(1, order):
                context = documents - gone_documents if i == 0 else left(k - 1, grams[k - 1][d][i - 1])
                estimate.append(left(k, grams[k][d][i]) / context if context > 0 else 0.0)
            yield min(math.ceil(math.log2(context + 1)), FREQUENCY_BUCKETS - 1), [1 / (v + 1), *estimate]

    events = []
    for b in set(blocks):
        inside = [d for d in range(len(rows)) if blocks[d] == b and train[d]]
        deleted = [Counter(g for d in inside for g in grams[k][d]) for k in range(order)]
        gone = sum(deleted[0].values())
        events += [e for d in inside for e in tokens_of(d, deleted, gone, len(inside))]
    bucket, p = np.array([b for b, _ in events]), np.array([e for _, e in events])
    weights = {}
    for b in {*bucket, None}:
        some = p if b is None else p[bucket == b]
        w = np.full(order + 1, 1 / (order + 1))
        for _ in range(100):
            share = some * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = w
    return [sum(math.log10(np.dot(weights.get(b, weights[None]), e)) for b, e in tokens_of(d)) for d in range(len(rows))]


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("size", [1, 2, 5, 60])
def test_learned_scores_equal_brute_force(spark, order, size):
    """The whole model, weights included; 1 to 5 documents leave blocks empty."""
    rng = random.Random(size)
    rows = [(k, " ".join(rng.choices(["a", "b", "c", "dd", "e"], weights=[8, 4, 2, 1, 1], k=rng.randrange(1, 50))), "en", "s") for k in range(size)]
    df = docs(spark, rows)
    dealt = df.select("doc_id", F.pmod(F.xxhash64("doc_id", "text", F.lit(0).cast("long")), F.lit(LEAST_BLOCKS)).alias("b"))
    block = {r["doc_id"]: r["b"] for r in dealt.collect()}
    train = [size < 6 or k % 7 != 2 for k in range(size)]
    got = {r["doc_id"]: r["score"] for r in interpolated_scores(df, F.lit(size < 6) | (F.col("doc_id") % 7 != 2), order=order).collect()}
    want = brute_learned(rows, train, order, [block[k] for k in range(size)])
    assert [got[k] for k in range(size)] == pytest.approx(want, rel=2e-3, abs=2e-3)


def test_levels_of_exchange_do_not_change_scores(spark):
    """A fan-out of 2 needs three levels for 8 blocks and more for 20; counts and scores stay."""
    rng = random.Random(8)
    rows = [r for r in ROWS if r[0] is not None] + [(50 + k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(90))), "en", "s") for k in range(60)]
    for block_bytes in (1_000_000, 11_000):
        one, many = (
            sorted(tuple(r) for r in interpolated_scores(docs(spark, rows), F.col("doc_id") % 5 != 1, block_bytes=block_bytes, fan_bits=bits).collect())
            for bits in (12, 1)
        )
        assert one == many


def test_one_repeated_null_row_is_spread_over_blocks(spark):
    rows = docs(spark, [(None, "same text here", "en", "s")] * 200 + [(1, "other", "en", "s")])
    got = interpolated_scores(rows, F.lit(True), order=2).collect()
    assert len(got) == 201 and {r["train_tokens"] for r in got} == {802} and len({r["score"] for r in got}) == 2


def brute_language(train, texts, longest=5):
    """Word-first backoff on dictionaries."""
    words = lambda t: __import__("re").findall(r"[^\W\d_]+", t.lower())
    langs = sorted({lang for _, t, lang in train if t is not None and lang is not None})
    counts = [{lang: Counter() for lang in langs} for _ in range(longest + 1)]
    for _, t, lang in train:
        if t is not None and lang is not None:
            counts[0][lang].update(words(t))
    for lang in langs:
        for word in counts[0][lang]:
            for n in range(1, longest + 1):
                counts[n][lang].update(set(lang_id.grams(word, n)))

    def row(n, key):
        v = len(set().union(*counts[n].values()))
        p = [math.log((counts[n][x][key] + 0.1) / (counts[n][x].total() + 0.1 * v)) for x in langs]
        return np.array(p) - math.log(sum(map(math.exp, p)))

    def score(word):
        for n, keys in [(0, [word]), *((n, lang_id.grams(word, n)) for n in range(longest, 0, -1))]:
            known = [row(n, k) for k in keys if any(counts[n][x][k] for x in langs)]
            if known:
                return np.mean(known, axis=0)
        return np.zeros(len(langs))

    out = []
    for t in texts:
        found = words(t or "")
        if not found:
            out.append(("und", 0.0))
            continue
        total = sum(score(w) for w in found)
        out.append((langs[int(total.argmax())], 1 / np.exp(total - total.max()).sum()))
    return out


def test_language_equals_brute_force_in_any_partitioning(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [tuple(r) for r in rows if r["doc_id"] % 3 == 0][:40]
    texts = [*(r["text"][:400] for r in rows[:60]), "xyzzy Qwhouse", "", None, "12 34"]
    df = spark.createDataFrame(train, "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = brute_language({(t, lang): (i, t, lang) for i, t, lang in train}.values(), texts)  # copies teach once
    for parts in (1, 50):
        model = lang_id.fit(df.repartition(parts))
        got = {r["doc_id"]: r for r in lang_id.predict(asked.repartition(parts), model).collect()}
        assert [got[k]["lang_pred"] for k in range(len(texts))] == [lang for lang, _ in want]
        assert [got[k]["score"] for k in range(len(texts))] == pytest.approx([p for _, p in want], rel=1e-4)


def test_samples_are_bounded_whatever_the_ids(spark):
    """A third of the rows without id, a third with one id, a third one row; ids never choose."""
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(4))
    rows = [(None, text(), "en", k % 2) for k in range(600)] + [(7, text(), "de", k % 2) for k in range(600)] + [(9, "one row of many", "en", 1)] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    known = lambda n: len(lang_id.fit(df, sample_docs=n).keys[0]) // 4
    assert 40 < known(90) < 95 and 1150 < known(2_000) <= 1201  # some random words coincide
    few = quality.fit(df, sample_docs=90, buckets=1 << 14)
    assert 0 < np.count_nonzero(few) < 90 * 8
    renamed = df.withColumn("doc_id", F.monotonically_increasing_id()).repartition(5)
    assert np.array_equal(quality.fit(renamed, sample_docs=90, buckets=1 << 14), few)


def test_learned_scores_do_not_depend_on_the_layout(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    some = [(None if k % 2 else r["doc_id"], r["text"], "en", "s") for k, r in enumerate(rows)] + [(None, "the same words again", "en", "s")] * 20
    scores = []
    for parts in (1, 3, 8):
        got = interpolated_scores(docs(spark, some).repartition(parts), F.lit(True), block_bytes=30_000)
        scores.append(sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"]) for r in got.collect()))
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 80


def brute_quality(train, texts, buckets, order, epochs=4, alpha=2.0, beta=1.0, l1=0.02, l2=0.1):
    """FTRL-proximal for logistic regression on dictionaries, by the published update; features by their definition."""
    import xxhash

    mask = 2**64 - 1

    def features(text):
        h = []
        for token in __import__("re").findall(r"\w+|[^\w\s]+", text or ""):
            h.append(xxhash.xxh64_intdigest(token.lower().encode()))
        stutter = xxhash.xxh64_intdigest(b"=")
        h = [stutter if k and h[k] == h[k - 1] else x for k, x in enumerate(h)]
        pairs = [(a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29)) * 0xBF58476D1CE4E5B9) & mask for a, b in zip(h, h[1:])]
        n = Counter(x % (buckets - 1) + 1 for x in h + [p ^ (p >> 31) for p in pairs])
        norm = math.sqrt(sum(c * c for c in n.values())) or 1.0
        return {0: 1.0} | {k: c / norm for k, c in n.items()}

    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    predict = lambda f: 1 / (1 + math.exp(-sum(weight(k) * x for k, x in f.items())))
    for _ in range(epochs):
        for i in order:
            text, y = train[i]
            f = features(text)
            error = predict(f) - y
            for k, (x, w) in {k: (x, weight(k)) for k, x in f.items()}.items():
                g = error * x
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w
                n[k] += g * g
    return [predict(features(t)) for t in texts]


def test_quality_equals_brute_force(spark):
    rng = random.Random(3)
    good, bad = ["clear", "text", "about", "rivers", "and", "hills"], ["buy", "now", "!!!", "click", "click", "free"]
    train = {i: (" ".join(rng.choices(good if i % 2 else bad, k=rng.randrange(4, 30))), i % 2) for i in range(60)}
    texts = [" ".join(rng.choices(good + bad, k=12)) for _ in range(25)] + ["", "new words only"]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in train.items()], "doc_id long, text string, quality int")
    order = [r["doc_id"] for r in df.orderBy(F.xxhash64("text", F.lit("fit"))).select("doc_id").collect()]
    w = quality.fit(df, buckets=1 << 12)
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(asked, w).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(brute_quality(train, texts, 1 << 12, order), abs=1e-4)


def test_quality_query_takes_clashing_and_repeated_labels(spark, tmp_path):
    rows = docs(spark, [(k, "good clean text here" if k % 2 else "bad bad !!! junk", "en", "s") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    for name, extra, times in (("plain", rows, 1), ("clash", rows.withColumns({"quality": F.lit("z"), "labelled": F.lit(1), "score": F.lit("s")}), 3)):
        extra.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.withColumn("copies", F.explode(F.sequence(F.lit(1), F.lit(times)))).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    one, two = ({tuple(r) for r in queries.op10_quality(spark, f"{tmp_path}/{name}").collect()} for name in ("plain", "clash"))
    assert one == two and len(one) == 40
