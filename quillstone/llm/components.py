"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.frames import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.select("u", F.col("m").alias("v")).unionByName(joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node of u's component, for every u that isn't itself the least.

    ``edges`` are pairs (u, v), u > v, of any orderable type. Each round is
    written to the shared folder; rounds go on until nothing changes, which for
    components of diameter d takes a number in the order of log d.
    """
    state = None
    while True:
        edges = materialise(_small(_large(edges)), "stars")
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == state:
            return edges
        state = now
