"""Connected components of an edge table, without bringing edges to the driver.

Alternating large-star and small-star rounds: every node points its larger (then its
smaller) neighbours at the least node it knows, until nothing changes. A round is two
aggregations with map-side combine and two joins that adaptive execution can split, so a
component of any size stays distributed. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    pointed = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return pointed.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b): every node of an edge but the least of its component, with that least node."""
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    for _ in range(rounds):
        last, edges = edges, materialise(_small_star(_large_star(edges)))
        discard(last)  # a round reads only the one before it
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if now == before:
            return edges
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
