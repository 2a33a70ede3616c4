"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rounds needed grow with the logarithm of the longest path; this many serve any table.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (id, root), root the least id of the component; ids without an edge are absent.

    Only neighbour minima are aggregated, so no group is collected; each round is a written table.
    """
    spark = edges.sparkSession
    pairs = materialize(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        # large star: neighbours above a node go to the least of its neighbourhood
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its lower neighbours go to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        new = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(small.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(spark, new, "edges")
        sums = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))]
        done = new.agg(*sums).first() == pairs.agg(*sums).first()
        pairs = new
        if done:
            break
    else:
        raise RuntimeError("the components did not settle")
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
