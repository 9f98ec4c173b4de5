"""Search of many strings against plain containment."""

import random

from pyspark.sql import functions as F

from vigilspark.functions.words import weighted_classes, word_numbers
from vigilspark.operators import linking as L
from vigilspark.operators.patterns import contained, contained_by_grams

SCHEMA = "id long, text string"


def some(seed, n=200):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcé.") for _ in range(rng.randrange(a, b)))
    texts = [(k if k % 9 else None, word(0, 40)) for k in range(n)] + [(1, None), (2, ""), (3, "abc"), (3, "abc")]
    patterns = [word(1, 9) for _ in range(120)] + ["", "abc", "abc", None, "never found"]
    return texts, patterns


def expected(texts, patterns):
    rows = [(i, p) for i, t in texts if t is not None for p in {p for p in patterns if p is not None} if p in t]
    return sorted(rows, key=str)


def test_both_ways_equal_plain_containment(spark):
    for seed in (1, 2):
        texts, patterns = some(seed)
        t = spark.createDataFrame(texts, SCHEMA).repartition(3)
        p = spark.createDataFrame([(x,) for x in patterns], "pattern string")
        want = expected(texts, patterns)
        for got in (contained(t, p), contained(t, p, most_chars=10), contained_by_grams(t, p.distinct().where("pattern is not null"), gram=2)):
            assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_empty_lists_and_tables(spark):
    t = spark.createDataFrame([(1, "a")], SCHEMA)
    none = spark.createDataFrame([], "pattern string")
    assert contained(t, none).count() == contained_by_grams(t, none).count() == 0
    assert contained(t.where("false"), spark.createDataFrame([("a",)], "pattern string")).count() == 0
    assert [r["hits"] for r in t.select(word_numbers([])("text").alias("hits")).collect()] == [[]]


def test_word_numbers_and_weights(spark):
    words = ["guaranteed", "antee", "", "double money", "antee"]
    t = spark.createDataFrame([(1, "guaranteed returns"), (2, "nothing"), (3, None), (4, "")], SCHEMA)
    hits = word_numbers(words)(F.col("text"))
    got = {r["id"]: (r["hits"], r["sums"]) for r in t.select("id", hits.alias("hits")).select("id", "hits", weighted_classes(F.col("hits"), [0, 1, 2, 0, 1], [1, 2, 4, 8, 16], 3).alias("sums")).collect()}
    assert got == {1: ([0, 1, 2, 4], [1.0, 18.0, 4.0]), 2: ([2], [0.0, 0.0, 4.0]), 3: ([], [0.0, 0.0, 0.0]), 4: ([2], [0.0, 0.0, 4.0])}


def test_blocklist_of_any_size(spark):
    rng = random.Random(5)
    domains = sorted({"".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 9))) + ".in" for _ in range(3000)})
    urls = [(k, f"http://{rng.choice(['www.', ''])}{rng.choice(domains) if k % 3 else 'zz.org'}/{rng.choice(domains)}") for k in range(300)]
    u, d = spark.createDataFrame(urls, "id long, url string"), spark.createDataFrame([(x,) for x in domains], "domain string")
    want = {(i, x) for i, url in urls for x in domains if x in url}
    assert {tuple(r) for r in L.blocklist_substring(u, d, first_only=False).collect()} == want
    first = {tuple(r) for r in L.blocklist_substring(u, d, first_only=True).collect()}
    assert first == {(i, min(x for j, x in want if j == i)) for i, _ in want}
