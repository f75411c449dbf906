"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrain.session import settle


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free checksum of an edge list."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any comparable type, undirected -> ``(node, root)`` with root the least
    node of the component; nodes without a partner do not appear.

    Each pass aggregates with map-side minima and joins back on the node, a join that AQE splits
    when one node holds many edges; no adjacency list is ever collected.  Passes are logarithmic
    in the longest chain.  Null ends and self-loops are ignored; no edges give an empty result.
    """
    flat = edges.where("a is not null and b is not null and a <> b")
    now = settle(flat.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        now = settle(hung.union(least.select("a", F.col("m").alias("b"))).distinct())
        last, seen = seen, _mark(now)
        if seen == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
