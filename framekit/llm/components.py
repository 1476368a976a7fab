"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """id, root: the least id reachable, for every id of ``edges`` (columns ``a`` and ``b``, both long).

    Every round hangs neighbours under the least id seen (large star, then small star), which halves distances in
    the hanging trees, so rounds grow with the logarithm of a component's size. Only counts and a checksum reach
    the driver. Rounds end when the edges no longer change. Minima are aggregated map-side and joined back, so that
    the centre of a large star is no group of one task; each round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = cut(e, "edges"), None
    while (state := tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())) != last and state[0]:
        last = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = cut(small.where("a <> b").distinct(), "edges")
    roots = e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
