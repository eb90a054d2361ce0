"""Connected components of an edge list by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node reachable. Self-edges and repeats are allowed.

    Each round is written to the shared folder, so a lost executor costs one round at most. It ends when a round
    leaves the edges as they were: then each points straight at its root.
    """
    spark = edges.sparkSession
    now = save(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = save(large.distinct(), "cc-large")
        least = kept.groupBy("u").agg(F.min("v").alias("m"))
        small = kept.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        new = save(small.distinct(), "cc")
        drop(spark, now.scratch)
        drop(spark, kept.scratch)
        now, last, mark = new, mark, _mark(new)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free digest of the edges, which are distinct; a sum of hashes would overflow beyond some 16 million."""
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
