"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progcorpus.llm.common import store


def _print(edges: DataFrame):
    """Count and order-free hash sum, to see whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``u, v``: every node that has an edge, with the least node of its
    component (least nodes themselves are left out).

    Alternating large-star and small-star rounds: each node's larger
    neighbours are tied to the least node it knows, then its smaller ones.
    The number of rounds grows with the logarithm of the component size, and a
    round moves an edge list no longer than the one before.  The edge list is
    stored after every half round, so neighbourhood minima join it as plain
    scans (a hot node is split by adaptive execution).
    """
    e = store(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
              "edges")
    seen = _print(e)
    while True:
        both = store(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
        least = store(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = store(both.where(F.col("v") > F.col("u")).join(least, "u")
                      .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))))
        e = store(small.distinct(), "edges")
        now = _print(e)
        if now == seen:
            return e
        seen = now
