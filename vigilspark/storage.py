"""Intermediate tables in the folder that all executors share.

Long lineages are cut by writing Parquet below ``spark.checkpoint.dir`` and
reading it again: the files outlive any executor, so a lost executor only costs
the tasks it was running.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset: a temporary folder in local mode (one machine, one JVM),
    otherwise a folder of the warehouse, which executors share as well.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    sc = spark.sparkContext
    chosen = sc._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get().rstrip("/")
    app = sc.applicationId
    if app not in _FALLBACK:
        if sc.master.startswith("local[") or sc.master == "local":
            _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="vigilspark-shared-")
        else:
            _FALLBACK[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_vigilspark"
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/vigilspark/{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of :func:`new_path` that nothing reads any more."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop_path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts the lineage)."""
    return materialize_at(df, new_path(df.sparkSession, name))


def materialize_at(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """As :func:`materialize`, at a given path, with another compression than the session's if ``codec`` names one.

    Nothing reads the shuffles of a plan whose result is written, so Spark is
    told to remove their files when the write ends; the caller's own setting is
    put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN_UP, None)
    conf.set(_CLEAN_UP, "true")
    try:
        (df.write.option("compression", codec) if codec else df.write).mode("overwrite").parquet(path)
    finally:
        conf.unset(_CLEAN_UP) if before is None else conf.set(_CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
