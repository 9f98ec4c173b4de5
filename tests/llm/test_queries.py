"""The registered queries over whole tables against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import docs as make_docs
from tests.llm.test_decontam import naive_tiles
from tests.llm.test_dedup import brute_components, brute_lines, brute_print
from vigilspark.llm import lang_id, pii, queries
from vigilspark.llm.common import crc_fold
from vigilspark.llm.lm import FREQUENCY_BUCKETS, interpolated_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def token_rows(library, rows):
    out = []
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def contained(rows, items):
    """(document, item) pairs by tiling every pair that shares a word run, the plain way."""
    found = set()
    for i, text, *_ in rows:
        words = re.findall(r"\w+", (text or "").lower())
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for item, item_text in items:
            pattern = re.findall(r"\w+", (item_text or "").lower())
            if any(tuple(pattern[k : k + 5]) in runs for k in range(len(pattern) - 4)):
                # only words of the pattern matter; others cannot be part of a tile
                covered = sum(n for _, _, n in naive_tiles(pattern, [w if w in set(pattern) else k for k, w in enumerate(words)], 5))
                if covered >= 0.8 * len(pattern):
                    found.add((i, item))
    return found


def test_op1(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    small = [d for d in documents if len(d[1] or "") < 4000]
    ids = {d[0] for d in small}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontamination(spark, SF).collect()}
    assert got and {g for g in got if g[0] in ids} == contained(small, items)


def test_op2_and_op7(spark, documents, library):
    want = token_rows(library, documents)
    got = queries.op7_bpe_round_trip(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    counts = queries.op2_token_counts(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in counts) == [w[:2] for w in want]
    size = {d[0]: len((d[1] or "").encode()) for d in documents}
    assert all(r["n_bytes"] == size[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 1024) for r in counts)


def test_op4(spark, documents):
    got = {r["doc_id"]: r for r in queries.op4_pii_surrogates(spark, SF).collect()}
    attempts = {(r["kind"], r["canonical"]): r["attempt"] for r in pii.surrogates(spark.read.parquet(f"{SF}/documents.parquet"), queries.SURROGATE_KEY).collect()}
    for i, text, *_ in documents:
        assert (got[i]["text"], got[i]["n_entities"]) == pii.rewrite(text, queries.SURROGATE_KEY, attempts)
        for secret in re.findall(r"[\w.]+@mail\d\.example\.com|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b", text):
            assert secret not in got[i]["text"]


def test_op8(spark, documents):
    prints = [brute_print(t) for _, t, *_ in documents]
    want = sorted((d[0], f"{p:016x}", c) for d, p, c in zip(documents, prints, brute_components([d[0] for d in documents], prints)))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()) == want


def words_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + ["</s>"]


def test_op9(spark, documents):
    train = [w for i, t, *_ in documents if crc_fold(i, 7) != 2 for w in words_of(t)]
    c = Counter(train)
    n, v = len(train), len(c)
    got = {r["doc_id"]: r for r in queries.op9_lm_scores(spark, SF).collect()}
    better = 0
    for i, t, *_ in documents:
        w = words_of(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, crc_fold(i, 7) == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-10)
        better += r["score"] - r["base_score"] if r["held_out"] else 0
    assert better > 0


@pytest.mark.parametrize("order", [2, 3])
def test_interpolated_scores_equal_brute_force(spark, documents, order):
    rows = documents[:60]
    learn = {i: crc_fold(i, 7) != 2 for i, *_ in rows}
    weights = np.random.default_rng(1).dirichlet(np.ones(order + 1), FREQUENCY_BUCKETS)
    counts, n_docs = Counter(), 0
    for i, t, *_ in rows:
        if learn[i]:
            n_docs += 1
            padded = ["<s>"] * (order - 1) + words_of(t)
            for k in range(1, order + 1):
                counts.update(tuple(padded[j - k + 1 : j + 1]) for j in range(order - 1, len(padded)))
    total = sum(x for g, x in counts.items() if len(g) == 1)
    size = sum(len(g) == 1 for g in counts)

    def history(h):
        return n_docs if set(h) == {"<s>"} else counts[h]

    def log_probability(t):
        padded, out = ["<s>"] * (order - 1) + words_of(t), 0.0
        for j in range(order - 1, len(padded)):
            w = weights[min(math.ceil(math.log2(history(tuple(padded[j - order + 1 : j])) + 1)), FREQUENCY_BUCKETS - 1)]
            p = w[0] / (size + 1) + w[1] * counts[(padded[j],)] / total
            for k in range(2, order + 1):
                seen = history(tuple(padded[j - k + 1 : j]))
                p += w[k] * counts[tuple(padded[j - k + 1 : j + 1])] / seen if seen else 0
            out += math.log10(p)
        return out

    df = make_docs(spark, rows)
    got = interpolated_scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, order=order, block_bytes=30_000, weights=weights).collect()
    for r in got:
        assert r["score"] == pytest.approx(log_probability(next(t for i, t, *_ in rows if i == r["doc_id"])), rel=1e-9)


def test_pipeline(spark, documents, library):
    """Every stage by its plain definition on what the stage before it kept."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = lang_id.Scorer(lang_id.fit(source))
    rows = [d for d in documents if (p := scorer.predict([d[1]])[0])[0] != "und" and p[1] >= 0.5]
    cleaned = {i: t for i, t, _, _ in brute_lines(rows)}
    rows = [(i, cleaned[i], lang, s) for i, _, lang, s in rows]
    prints = [brute_print(t) for _, t, *_ in rows]
    rows = [r for r, c in zip(rows, brute_components([r[0] for r in rows], prints)) if r[0] == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {i for i, _ in contained(rows, items)}
    rows = [r for r in rows if r[0] not in gone]
    assert gone and len(rows) < len(documents)
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == token_rows(library, rows)


def test_stage_columns_and_awkward_rows(spark):
    current = make_docs(spark)
    names = current.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SF)
        assert current.columns == names
        current = spark.createDataFrame(current.collect(), current.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, current, SF).count() == current.count() > 0
    empty = make_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_stages_decide_by_row(spark):
    """Null and repeated ids: only the row that is a near copy or contaminated goes."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b, c, d = (" ".join(f"{w}{k * k % 97}" for k in range(60)) for w in ("alpha", "beta", "gamma", "delta"))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, c), (2, c), (2, d), (3, d)]
    near = corpus_pipeline.near_duplicate_stage(spark, make_docs(spark, [(i, t, "en", "s") for i, t in rows]), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in near) == Counter([(1, a), (None, b), (2, c), (2, d)])
    rows = [(None, item), (None, a), (4, item), (4, b), (5, c), (5, c)]
    clean = corpus_pipeline.decontamination_stage(spark, make_docs(spark, [(i, t, "en", "s") for i, t in rows]), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in clean) == Counter([(None, a), (4, b), (5, c), (5, c)])
