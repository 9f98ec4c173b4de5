"""Connected components by alternating large-star and small-star rounds (GR-1, GR-2).

Each round is two aggregations and two equi joins on edges, so a hub with
millions of neighbours is pre-aggregated map-side and its join side is split by
adaptive execution; no group is gathered in one task and nothing but one small
fingerprint of the edge set per round reaches the driver.  Rounds grow with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.storage import drop_path, materialize_at, new_path

#: Edges that one file of a round holds at least.
EDGES_A_FILE = 200_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where("v > u").join(low, "u")
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every endpoint of ``edges``; component = smallest node.

    Edges are undirected; nulls, self-loops and repeats are ignored (a node that
    only has self-loops is its own component).  Nodes of any orderable type.
    An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    start = new_path(spark, "edges")
    base = materialize_at(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), start)
    current, path = base.where("a <> b"), None
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        following = new_path(spark, "round")
        # a round makes no more edges than it got, so few edges need few files
        narrowed = _small_star(_large_star(current)).coalesce(seen[0] // EDGES_A_FILE + 1)
        current = materialize_at(narrowed, following)
        if path:
            drop_path(spark, path)
        path, now = following, _fingerprint(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    alone = base.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return (
        stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
    )


def _fingerprint(edges: DataFrame) -> tuple:
    """Order-free checksum of an edge set: three numbers, none of which grows beyond 64 bits."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first()
    return (row[0], row[1], row[2])
