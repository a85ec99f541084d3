"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbline.llm.shared import stored


def _nearest(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with the smallest v of each u; the small side is stored, so skewed u can be split."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("least")), "least")
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """`node`, `component` (smallest node reachable) of every node in links (`a`, `b`, of one type).

    Alternates the large and small star: first every larger neighbour, then every smaller neighbour of
    a node is linked with its smallest one. Rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder. Loops and repeated links do no harm; without links the
    result is empty.
    """
    ends = F.struct(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
    edges = stored(links.select(ends.alias("e")).select("e.u", "e.v").where("u != v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        large = stored(large.where("u != v").distinct(), "large")
        small = _nearest(large)
        small = small.where("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        edges = stored(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
