"""Case management: statistics, search, entity history, logs (PR-*, AG-1..8, AG-17..21, JN-9/10, WN-7..9, SO-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vigilspark.operators.scan import numbered


def status_counts(cases: DataFrame) -> DataFrame:
    """One pass over the cases: total and a count for each status (AG-1)."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "APPROVED", "REJECTED", "SUBMITTED", "ESCALATED")]
    return cases.agg(F.count("*").alias("total"), *counts)


def count_by(df: DataFrame, column: str, alias: str, unknown: str = "Unknown") -> DataFrame:
    """Rows by value, null as ``unknown`` (AG-2, AG-3)."""
    return df.groupBy(F.coalesce(column, F.lit(unknown)).alias(alias)).agg(F.count("*").alias("n"))


def filter_cases(df: DataFrame, status=None, category=None, severity=None, date_from=None, date_to=None, search=None) -> DataFrame:
    """Conjunction of whatever filters are given (PR-2); pushed to the scan where they are comparisons."""
    for column, value in (("status", status), ("category", category), ("severity", severity)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if date_from is not None:
        df = df.where(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to is not None:
        df = df.where(F.col("created_at") <= F.lit(date_to).cast("timestamp"))
    return search_columns(df, search, [c for c in df.columns if dict(df.dtypes)[c] == "string"]) if search else df


def search_columns(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring in any of the columns (PR-3)."""
    mark = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{mark}%") for c in columns]))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of one page; the order must end in a unique key (SO-1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def daily_trend(cases: DataFrame, days: int = 7) -> DataFrame:
    """Cases of the last ``days`` days of the data, zero-filled, with the weekday (AG-5)."""
    daily = cases.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    last = cases.agg(F.max(F.to_date("created_at")).alias("last"))
    spine = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), "last")).alias("day"))
    return spine.join(daily, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("day", "E").alias("weekday"), F.coalesce("n", F.lit(0)).alias("n")
    )


def trend_by(cases: DataFrame, column: str, values: list[str], days: int = 7) -> DataFrame:
    """Day by value counts of the last days, one column for each value (AG-19)."""
    dated = cases.withColumn("day", F.to_date("created_at"))
    recent = dated.where(F.col("day") > F.date_sub(dated.agg(F.max("day")).scalar(), days))
    wide = recent.groupBy("day").agg(*[F.count_if(F.col(column) == v).alias(v.lower()) for v in values])
    return wide.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def hourly_distribution(df: DataFrame, ts: str) -> DataFrame:
    """Rows for each hour 0..23, zero-filled (AG-20)."""
    spine = df.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    counts = df.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return spine.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def repeat_entities(entities: DataFrame, min_cases: int = 3) -> DataFrame:
    """Entities of at least ``min_cases`` cases; five make a ring (AG-17)."""
    found = entities.groupBy("entity_type", "value").agg(
        F.count_distinct("case_id").alias("case_count"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    ring = F.col("case_count") >= 5
    return found.where(F.col("case_count") >= min_cases).select(
        "entity_type", "value", "case_count", ring.alias("is_ring"), F.when(ring, "CRITICAL").otherwise("HIGH").alias("alert"), "first_seen", "last_seen"
    )


def top_entities(entities: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The ``n`` most flagged values of a type (AG-4, SO-3); the limit is the report."""
    flags = entities.where(F.col("entity_type") == kind).groupBy("value").agg(F.count("*").alias("flags"))
    return flags.orderBy(F.desc("flags"), "value").limit(n)


def running_flags(entities: DataFrame) -> DataFrame:
    """Occurrence number of each row of a (type, value), and their total (WN-7, WN-8); an entity with most rows is split among tasks."""
    order = ["seen_at", "case_id", "line", "amount"]
    rows = numbered(entities.select("case_id", "line", "entity_type", "value", "seen_at", "amount"), ["entity_type", "value"], order, "occurrence")
    totals = entities.groupBy("entity_type", "value").agg(F.count("*").alias("flag_count"))
    named = totals.select(F.col("entity_type").alias("_t"), F.col("value").alias("_v"), "flag_count")
    joined = rows.join(named, rows["entity_type"].eqNullSafe(named["_t"]) & rows["value"].eqNullSafe(named["_v"]))
    return joined.select("case_id", "line", "entity_type", "value", F.col("occurrence").cast("int").alias("occurrence"), "flag_count")


def entity_history(cases: DataFrame, entities: DataFrame, value: str) -> DataFrame:
    """Cases that an entity was seen in (PR-6): a semi join."""
    return cases.join(entities.where(F.col("value") == value).select("case_id"), "case_id", "left_semi")


def with_entities(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Each case with the sorted set of its entities (JN-9): one aggregation instead of a query for each case."""
    held = entities.groupBy("case_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "entity_type", "value"))).alias("entities"))
    return cases.join(held, "case_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key (WN-9, SC-11): append-only logs and upserts."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def victim_clusters(complaints: DataFrame) -> DataFrame:
    """Complaints that share an accused phone, payment address or handle, at least two (AG-21)."""
    long = complaints.select(
        "complaint_id", "district", "loss",
        F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("PHONE", "phone"), ("UPI", "upi"), ("TELEGRAM", "telegram"))])).alias("e"),
    ).where("e.value is not null and e.value <> ''")
    grouped = long.groupBy(F.col("e.kind").alias("kind"), F.col("e.value").alias("value")).agg(
        F.count_distinct("complaint_id").alias("complaints"), F.round(F.sum("loss"), 2).alias("total_loss"), F.count_distinct("district").alias("districts")
    )
    return grouped.where("complaints >= 2")
