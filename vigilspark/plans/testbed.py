"""Canonical tables of the domain made from the TPC-H-like test tables, in Spark and as SQL.

cases: orders; entities: lineitem; officers: customer with its nation as district;
channel posts: events; channel texts: documents by source number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.functions import fixed as X

CATEGORY_IDS = [c[0] for c in X.CATEGORIES]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_list(values: list) -> str:
    """A DuckDB list literal."""
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def sql_any(column: str, words: list[str]) -> str:
    """SQL for: the lower-cased column contains any of the words."""
    return "(" + " OR ".join(f"contains(lower({column}), '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, status, severity, category, created_at, loss, officer_id); some categories are null."""
    o = read(spark, sf_dir, "orders")
    ids = F.array(*[F.lit(c) for c in CATEGORY_IDS])
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("SUBMITTED").alias("status"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "MEDIUM").when(F.col("o_orderpriority") == "5-LOW", "LOW").alias("severity"),
        F.get(ids, (F.col("o_custkey") % 15).cast("int")).alias("category"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("loss"),
        F.col("o_custkey").alias("officer_id"),
    )


CASES = f"""cases AS (
  SELECT o_orderkey AS case_id,
         CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'APPROVED' ELSE 'SUBMITTED' END AS status,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' WHEN '5-LOW' THEN 'LOW' END AS severity,
         ({sql_list(CATEGORY_IDS)})[CAST(o_custkey % 15 AS INTEGER) + 1] AS category,
         o_orderdate AS created_at, o_totalprice AS loss, o_custkey AS officer_id
  FROM orders)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, line, entity_type, value, seen_at, qty): what was seen in which case."""
    li = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "PHONE").when(F.col("l_returnflag") == "N", "UPI").otherwise("URL")
    return li.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), kind.alias("entity_type"),
        F.concat(F.lower(kind), F.lit("-"), F.col("l_partkey").cast("string")).alias("value"),
        F.col("l_shipdate").alias("seen_at"), F.col("l_quantity").alias("qty"), F.col("l_suppkey").alias("channel"),
        F.col("l_extendedprice").alias("amount"), F.col("l_linestatus").alias("line_status"),
    )


ENTITIES = """entities AS (
  SELECT l_orderkey AS case_id, l_linenumber AS line,
         CASE l_returnflag WHEN 'A' THEN 'PHONE' WHEN 'N' THEN 'UPI' ELSE 'URL' END AS entity_type,
         lower(CASE l_returnflag WHEN 'A' THEN 'PHONE' WHEN 'N' THEN 'UPI' ELSE 'URL' END) || '-' || CAST(l_partkey AS VARCHAR) AS value,
         l_shipdate AS seen_at, l_quantity AS qty, l_suppkey AS channel, l_extendedprice AS amount, l_linestatus AS line_status
  FROM lineitem)"""


def channel_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, entity_type, value), distinct: the contact points a channel shows."""
    return entities(spark, sf_dir).select("channel", "entity_type", "value").distinct()


CHANNEL_ENTITIES = (
    ENTITIES + """, channel_entities AS (SELECT DISTINCT channel, entity_type, value FROM entities)"""
)


def contact_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact points and the images a channel shows, as attribution compares them; rows repeat."""
    image = F.concat(F.lit("image-"), (F.col("l_partkey") * 7 + F.col("l_linenumber")).cast("string"))
    images = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("channel"), F.lit("IMAGE").alias("entity_type"), image.alias("value"))
    return entities(spark, sf_dir).select("channel", "entity_type", "value").unionByName(images)


CONTACT_POINTS = (
    CHANNEL_ENTITIES
    + """, points AS (SELECT * FROM channel_entities UNION ALL
  SELECT DISTINCT l_suppkey, 'IMAGE', 'image-' || CAST(l_partkey * 7 + l_linenumber AS VARCHAR) FROM lineitem)"""
)


def payment_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, entity_type, value), distinct: how a channel is paid; kinds differ by channel, codes are QR."""
    li, channel = read(spark, sf_dir, "lineitem"), F.col("l_suppkey")
    kind = (
        F.when(F.col("l_returnflag") == "A", F.when(channel % 5 == 0, "URL").otherwise("PHONE"))
        .when(F.col("l_returnflag") == "N", F.when((channel % 2 == 0) | (F.col("l_linenumber") % 2 == 0), "UPI").otherwise("QR")).otherwise("URL")
    )
    page = F.when(channel % 3 == 0, "https://usdt-pay.example/").otherwise("https://shop.example/")
    value = F.concat(F.when(kind == "URL", page).otherwise(F.concat(F.lower(kind), F.lit("-"))), F.col("l_partkey").cast("string"))
    return li.select(channel.alias("channel"), kind.alias("entity_type"), value.alias("value")).distinct()


PAYMENTS = """kinds AS (SELECT l_suppkey AS channel, l_partkey, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_suppkey % 5 = 0 THEN 'URL' ELSE 'PHONE' END
    WHEN 'N' THEN CASE WHEN l_suppkey % 2 = 0 OR l_linenumber % 2 = 0 THEN 'UPI' ELSE 'QR' END ELSE 'URL' END AS entity_type FROM lineitem),
  payments AS (SELECT DISTINCT channel, entity_type, CASE WHEN entity_type <> 'URL' THEN lower(entity_type) || '-' WHEN channel % 3 = 0 THEN 'https://usdt-pay.example/' ELSE 'https://shop.example/' END || CAST(l_partkey AS VARCHAR) AS value FROM kinds),
  k AS (SELECT channel, count(*) FILTER (WHERE entity_type = 'UPI') AS upis, count(*) FILTER (WHERE entity_type = 'PHONE') AS phones, count(*) FILTER (WHERE entity_type = 'URL') AS urls, count(*) FILTER (WHERE entity_type = 'QR') AS qrs,
    count(*) FILTER (WHERE entity_type = 'URL' AND (contains(lower(value), 'bitcoin') OR contains(lower(value), 'btc') OR contains(lower(value), 'eth') OR contains(lower(value), 'usdt'))) AS cryptos FROM payments GROUP BY 1),
  pd AS (SELECT *, (CAST(upis > 0 AS INTEGER) + CAST(phones > 0 AS INTEGER) + CAST(qrs > 0 AS INTEGER) + CAST(cryptos > 0 AS INTEGER)) / 4 AS payment_diversity FROM k)"""


def channel_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, message_id, ts, views, reactions, forwards, replies, media): posts with their counters."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("channel"), F.col("event_id").alias("message_id"), "ts", F.floor("value").alias("views"),
        (F.col("event_type") == "click").cast("int").alias("reactions"), (F.col("event_type") == "signup").cast("int").alias("forwards"),
        (F.col("event_type") == "purchase").cast("int").alias("replies"),
        F.when(F.col("event_type") == "view", "images").when(F.col("event_type") == "error", "links").when(F.col("event_type") == "signup", "videos").otherwise("none").alias("media"),
    )


POSTS = """posts AS (
  SELECT user_id AS channel, event_id AS message_id, ts, CAST(floor(value) AS BIGINT) AS views,
         CAST(event_type = 'click' AS INTEGER) AS reactions, CAST(event_type = 'signup' AS INTEGER) AS forwards,
         CAST(event_type = 'purchase' AS INTEGER) AS replies,
         CASE event_type WHEN 'view' THEN 'images' WHEN 'error' THEN 'links' WHEN 'signup' THEN 'videos' ELSE 'none' END AS media
  FROM events)"""


def channel_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, message_id, text): text posts of the numbered sources."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.substring("source", 4, 9).cast("long").alias("channel"), F.col("doc_id").alias("message_id"), "text")


TEXTS = """texts AS (SELECT CAST(substr(source, 4) AS BIGINT) AS channel, doc_id AS message_id, text FROM documents)"""
