"""Connected components of an edge table, in rounds of stars."""

from pyspark.sql import DataFrame, functions as F

from dayloom.llm.common import stage


def components(edges: DataFrame, write=stage) -> DataFrame:
    """Map each node of ``edges(u, v)`` that is not a smallest one to its component's smallest.

    Alternates large-star and small-star steps until nothing changes.  Every round is joins and
    partial aggregates over the edge table; only one digest row a round reaches the driver.
    Null ends and loops are no edges.  An empty table gives an empty table.  ``write`` stages a round.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, digest = _settle(edges, write)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = _settle(small.union(low.select("u", F.col("m").alias("v"))).distinct(), write)
        if now == digest:
            return edges
        digest = now


def _settle(edges, write):
    edges = write(edges, "edges")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"),
                    F.sum(F.xxhash64("v", "u") % 1000003).alias("s")).first()
    return edges, tuple(row)
