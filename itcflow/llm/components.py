"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest of its neighbourhood."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.where("b > a").join(low, "a").where("b <> m")
                .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` edges (any comparable type, a <> b) -> ``node, root``: one row
    for every vertex that isn't the smallest of its component. Self-loops and
    rows with a null are ignored; an empty table gives an empty result.

    Each round rewrites the edge table (written to the shared folder) until
    a round changes nothing; every vertex then points to its component's
    smallest one. Rounds grow with the logarithm of the longest path.
    """
    e = materialize(_small_star(edges.select("a", "b").where("a <> b")), "edges")
    mark = None
    while True:
        e = materialize(_small_star(_large_star(e)), "edges")
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
