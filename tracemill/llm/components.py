"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.stored import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for nodes with edges.

    ``edges`` has two columns of longs, in either direction. Large-star and
    small-star steps take turns until every node hangs on the smallest one; a
    step sums up by node before it shuffles, and every round is stored.
    """
    a, b = edges.columns
    pairs = stored(
        edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .where("high != low")
        .distinct(),
        "edges",
    )
    seen = _state(pairs)
    while seen[0]:
        pairs = stored(_small_star(_large_star(pairs)), "edges")
        now = _state(pairs)
        if now == seen:
            break
        seen = now
    stars = pairs.select(F.col("high").alias("node"), F.col("low").alias("component"))
    roots = pairs.select(F.col("low").alias("node"), F.col("low").alias("component"))
    return stars.unionByName(roots.distinct())


def _state(pairs: DataFrame) -> tuple:
    return tuple(
        pairs.agg(
            F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))
        ).first()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the node's smallest neighbour."""
    both = pairs.unionByName(pairs.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.min("low").alias("least"))
    least = least.select(F.col("high").alias("node"), F.least("least", "high").alias("least"))
    # Pairs (larger, smaller): the smaller one is the node whose neighbours are joined.
    return (
        pairs.join(least, pairs.low == least.node)
        .select("high", F.col("least").alias("low"))
        .where("high != low")
        .distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is joined to the smallest of them."""
    least = pairs.groupBy("high").agg(F.min("low").alias("least"))
    moved = pairs.join(least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
    own = least.select("high", F.col("least").alias("low"))
    return moved.unionByName(own).where("high != low").distinct()
