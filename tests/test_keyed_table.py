"""Merges against a dictionary, with a crash between the files and the manifest."""

import random

import pytest
from pyspark.sql import functions as F

from vigilspark.sources import keyed_table as K

SCHEMA = "name string, area int, count long, note string"


def fold(state, rows):
    for name, area, count, note in rows:
        if (name, area) in state:
            old = state[name, area]
            state[name, area] = (old[0] + count, note if note is not None else old[1])
        else:
            state[name, area] = (count, note)


def rows_of(df):
    return {(r["name"], r["area"]): (r["count"], r["note"]) for r in df.collect()}


RULES = {"count": K.ADD, "note": K.NEWER}


def batch(rng, n=40):
    keys = {(rng.choice(["a", "b", "c", None, "d\u00e9"]), rng.choice([None, *range(12)])) for _ in range(n)}
    return [(name, area, rng.randrange(1, 9), rng.choice([None, "x", "y"])) for name, area in keys]


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    table = K.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["name", "area"], buckets=8)
    state = {}
    assert table.read().count() == 0 and table.version() == 0
    states = [{}]
    for _ in range(4):
        rows = batch(rng)
        fold(state, rows)
        states.append(dict(state))
        changes = spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1))
        assert table.merge(changes, RULES) == len(states) - 1
    for version, want in enumerate(states):
        assert rows_of(table.read(version)) == want
    again = K.KeyedTable(spark, f"{tmp_path}/t")
    assert rows_of(again.read()) == state and again.merge(spark.createDataFrame([], SCHEMA), RULES) == 4
    again.vacuum(keep=1)
    assert rows_of(again.read()) == state and len(list((tmp_path / "t" / "manifests").glob("[0-9]*.json"))) == 1


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = K.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["name", "area"], buckets=16)
    table.merge(spark.createDataFrame([(f"n{k}", k, 1, None) for k in range(200)], SCHEMA), RULES)
    before = table.manifest()["files"]
    table.merge(spark.createDataFrame([("n7", 7, 5, "new")], SCHEMA), RULES)
    after = table.manifest()["files"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert rows_of(table.read())["n7", 7] == (6, "new")


def test_a_merge_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = K.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["name", "area"], buckets=4)
    table.merge(spark.createDataFrame([("a", 1, 1, None)], SCHEMA), RULES)

    def die(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", die)
        with pytest.raises(OSError):
            table.merge(spark.createDataFrame([("a", 1, 10, None), ("b", 2, 1, None)], SCHEMA), RULES)
    assert table.version() == 1 and rows_of(table.read()) == {("a", 1): (1, None)}
    table.merge(spark.createDataFrame([("a", 1, 10, None)], SCHEMA), RULES)
    folders = lambda: len(list((tmp_path / "t" / "data").iterdir()))
    assert folders() == 3
    table.vacuum(keep=1)
    assert rows_of(table.read()) == {("a", 1): (11, None)} and folders() == 1


def test_the_second_of_two_merges_is_refused(spark, tmp_path):
    one = K.KeyedTable(spark, f"{tmp_path}/t", SCHEMA, ["name", "area"], buckets=4)
    stale = K.KeyedTable(spark, f"{tmp_path}/t")
    old = stale.manifest()
    one.merge(spark.createDataFrame([("a", 1, 1, None)], SCHEMA), RULES)
    stale.manifest = lambda version=None: old
    with pytest.raises(K.MergeConflict):
        stale.merge(spark.createDataFrame([("a", 1, 1, None)], SCHEMA), RULES)
    assert rows_of(one.read()) == {("a", 1): (1, None)}


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    import glob

    from vigilspark.sources import keyed_table as K

    monkeypatch.setattr(K, "ROWS_A_FILE", 100, raising=False)
    table = K.KeyedTable(spark, f"{tmp_path}/sliced", "k long, n long", ["k"], buckets=2)
    rows = spark.range(2_000).selectExpr("id AS k", "id % 7 AS n")
    table.merge(rows, {"n": K.ADD})
    assert len(glob.glob(f"{tmp_path}/sliced/data/*/_bucket=0/*.parquet")) > 1
    table.merge(rows.where("k < 1500"), {"n": K.ADD})
    assert sorted(map(tuple, table.read().collect())) == [(k, (k % 7) * (2 if k < 1500 else 1)) for k in range(2_000)]
