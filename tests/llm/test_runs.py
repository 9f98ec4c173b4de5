"""Periodic runs against a plain search."""

import hashlib
import random
import re
import zlib

import numpy as np

from tests.llm.helpers import ROWS, clashing, docs, rows_of
from vigilspark.llm import queries
from vigilspark.llm.runs import damage_cycle, names_by_level, runs_of_texts, word_runs

COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "text")


def brute(doc_id, text, damage=False):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if damage and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    runs = sorted((s, e - s, q) for (s, e), q in found.items())
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return doc_id, len(runs), *head, listed, " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(seed, n=150):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice("abcdef") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * rng.randrange(2, 9))[: rng.randrange(1, 50)]
        out.append((i if i % 11 else None, rng.choice([" ", "\n", "\t "]).join(words)))
    return out + [(500, "x " * 700), (501, "a b " * 300 + "a"), (502, None), (503, " \n"), (504, "ab cd " * 3), (505, ("p q r " * 5 + "z ") * 6)]


def test_runs_equal_search():
    texts = some_texts(1)
    got = [r[1:] for r in runs_of_texts(iter(texts), lambda i, n: None, 6, 4)]
    assert got == [brute(*t) for t in texts]
    assert sum(r[1] > 1 for r in got) > 15


def test_levels_stop_where_no_name_repeats():
    levels = names_by_level(np.array([0, 1, 0, 1, 2, 3], np.int32))
    assert [len(set(x.tolist())) for x in levels] == [4, 4]
    assert [len(x) for x in levels] == [6, 5]


def test_runs_of_awkward_rows(spark):
    want = sorted((brute(i, t) for i, t, *_ in ROWS), key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows_of(word_runs(docs(spark)), *COLUMNS) == want
    assert rows_of(word_runs(clashing(spark)), *COLUMNS) == want
    assert word_runs(docs(spark, [])).count() == 0


def test_long_periodic_text_and_other_limits():
    words = [f"w{i}" for i in range(9_000)] * 5
    (got,) = runs_of_texts(iter([(1, " ".join(words))]), lambda i, n: None, 6, 4)
    assert got[2:6] == (1, 0, 45_000, 9_000)
    assert got[-1] == " ".join(words[:9_000])
    (short,) = runs_of_texts(iter([(1, "a b a b c")]), lambda i, n: None, 4, 2)
    assert short[2:7] == (1, 0, 4, 2, 2000)


def test_damage_is_periodic():
    hurt = [i for i in range(200) if damage_cycle(i, 50)]
    assert hurt == [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert damage_cycle(None, 50) is None and damage_cycle(hurt[0], 0) is None


def test_op12_equals_search(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted(((*r[:6], sha(r[6]), sha(r[7])) for r in (brute(d["doc_id"], d["text"], True) for d in rows)), key=lambda r: tuple((v is None, str(v)) for v in r))
    got = rows_of(queries.QUERIES["op12_periodic_runs"](spark, sf), *COLUMNS[:6], "runs_sha256", "collapsed_sha256")
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10
