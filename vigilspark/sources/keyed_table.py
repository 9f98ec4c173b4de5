"""A table with one row for each key that changes are merged into (SC-11, SC-27, SC-28, SC-29).

Rows live in Parquet files by hash bucket of the key.  A merge reads and rewrites
only the buckets that its changes touch, into a folder of its own; a manifest then
names the files of the new version.  The manifest is written beside its place and
renamed, so readers see the old version or the new one, a merge that dies leaves
the old one, and of two merges of one version the second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rule = Callable[[Column, Column], Column]

#: Rules for columns of rows that are there already: ``(old, new) -> value``.
KEEP: Rule = lambda old, new: F.coalesce(old, new)
REPLACE: Rule = lambda old, new: new
NEWER: Rule = lambda old, new: F.coalesce(new, old)
ADD: Rule = lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))
LEAST: Rule = lambda old, new: F.least(old, new)
GREATEST: Rule = lambda old, new: F.greatest(old, new)


#: Rows that a task of a merge writes, about; a larger bucket is written by several tasks, a file each.
ROWS_A_FILE = 500_000


class MergeConflict(RuntimeError):
    """Another merge made the next version first."""


class KeyedTable:
    """``path`` holds ``manifests/<version>.json`` and ``data/<merge>/_bucket=<n>/``.

    ``buckets``: fixed when the table is created; choose it so that a bucket of the
    grown table fits a task.  Null key values are values like others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str | None = None, keys: list[str] | None = None, buckets: int = 32) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self.conf)
        if self.version() is None:
            if schema is None or not keys:
                raise ValueError("a new table needs a schema and keys")
            kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
            self._commit(0, {"schema": kind.jsonValue(), "keys": keys, "buckets": buckets, "files": {}})

    def _path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def version(self) -> int | None:
        """The newest version, None without a table."""
        place = self._path(f"{self.path}/manifests")
        if not self.fs.exists(place):
            return None
        names = [status.getPath().getName() for status in self.fs.listStatus(place)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=None)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        stream = self.fs.open(self._path(f"{self.path}/manifests/{number}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) | {"version": number}

    def _commit(self, version: int, manifest: dict) -> None:
        place, beside = self._path(f"{self.path}/manifests/{version}.json"), self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(beside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(beside, place):
            self.fs.delete(beside, False)
            raise MergeConflict(f"version {version} of {self.path} is taken")

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        files = sorted({f for b, f in manifest["files"].items() if buckets is None or int(b) in buckets})
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest or a given version."""
        return self._read(self.manifest(version))

    def merge(self, changes: DataFrame, rules: dict[str, Rule]) -> int:
        """Inserts rows with new keys, and changes the other columns of known ones by ``rules``; gives the new version.

        ``changes`` holds one row a key (fold repeats first) and the table's columns;
        others are left out, as are columns without a rule, which stay as they are.
        """
        manifest = self.manifest()
        keys, n = manifest["keys"], manifest["buckets"]
        columns = [f["name"] for f in manifest["schema"]["fields"]]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        new = changes.select(*columns).withColumn("_bucket", bucket)
        # the numbers of buckets, at most as many as the table has
        given_rows = {r["_bucket"]: r["count"] for r in new.groupBy("_bucket").count().collect()}
        touched = set(given_rows)
        if not touched:
            return manifest["version"]
        known = self._read(manifest, touched)
        slices = (known.count() + sum(given_rows.values())) // (len(touched) * ROWS_A_FILE) + 1
        old = known.withColumn("_bucket", bucket)
        o, c = old.select(F.struct(*columns).alias("o"), *[F.col(k).alias(f"_{k}") for k in keys], "_bucket"), new.select(F.struct(*columns).alias("n"), *[F.col(k).alias(f"_{k}") for k in keys], "_bucket")
        same = o["_bucket"].eqNullSafe(c["_bucket"])
        for k in keys:
            same = same & o[f"_{k}"].eqNullSafe(c[f"_{k}"])
        joined = o.join(c, same, "full").select("o", "n", F.coalesce(o["_bucket"], c["_bucket"]).alias("_bucket"))
        there, given = F.col("o").isNotNull(), F.col("n").isNotNull()

        def value(name: str) -> Column:
            was, now = F.col(f"o.{name}"), F.col(f"n.{name}")
            changed = rules[name](was, now) if name in rules else was
            kind = T.StructType.fromJson(manifest["schema"])[name].dataType
            return F.when(there & given & F.lit(name not in keys), changed).when(there, was).otherwise(now).cast(kind).alias(name)

        folder = uuid.uuid4().hex
        rows = joined.select(*[value(name) for name in columns], "_bucket")
        part = F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(slices))
        rows = rows.repartition(len(touched) * slices, "_bucket", part) if slices > 1 else rows.repartition(len(touched), "_bucket")
        rows.write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        files = manifest["files"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        self._commit(manifest["version"] + 1, {k: manifest[k] for k in ("schema", "keys", "buckets")} | {"files": files})
        return manifest["version"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Deletes old manifests but the last ``keep`` and all folders that none of those names, such as those of merges that died."""
        last = self.version()
        kept = [v for v in range(max(0, last - keep + 1), last + 1) if self.fs.exists(self._path(f"{self.path}/manifests/{v}.json"))]
        used = {f.split("/")[0] for v in kept for f in self.manifest(v)["files"].values()}
        for status in self.fs.listStatus(self._path(f"{self.path}/manifests")):
            name = status.getPath().getName()
            if name.startswith(".") or (name[:-5].isdigit() and int(name[:-5]) not in kept):
                self.fs.delete(status.getPath(), False)
        data = self._path(f"{self.path}/data")
        for status in self.fs.listStatus(data) if self.fs.exists(data) else []:
            if status.getPath().getName() not in used:
                self.fs.delete(status.getPath(), True)


def node_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    """Nodes of the graph (SC-28): created once, sights counted."""
    return KeyedTable(spark, path, "label string, key string, count long, first_seen timestamp, last_seen timestamp", ["label", "key"], buckets)


def edge_table(spark: SparkSession, path: str, buckets: int = 32) -> KeyedTable:
    """Edges of the graph (SC-29)."""
    return KeyedTable(spark, path, "src string, dst string, type string, count long, created_at timestamp, last_seen timestamp", ["src", "dst", "type"], buckets)


NODE_RULES = {"count": ADD, "first_seen": LEAST, "last_seen": GREATEST}
EDGE_RULES = {"count": ADD, "created_at": LEAST, "last_seen": GREATEST}


def vector_id(key: Column) -> Column:
    """The id of a vector of ``key`` (SC-27): a hash below 2^31."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31))
