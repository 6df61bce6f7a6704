"""Connected components of a graph that is a table of links.

Alternating large-star and small-star steps: each turns the links of a node
into links to the smallest neighbour, so chains shrink to stars in a number of
rounds that grows with the logarithm of their length.  Every step is an
aggregation and a join; a node with very many links is one group of a
``min`` with map-side combining, not a gathered list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galley.session import discard, materialize

MAX_ROUNDS = 50


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return joined.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id and component (its smallest id) of every node of a link; no link gives no row."""
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(f"{a} <> {b}").distinct()
    e = materialize(e, "links")
    state = None
    for _ in range(MAX_ROUNDS):
        before, e = e, materialize(_small_star(_large_star(e)), "star")
        discard(before)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == tuple(now):
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    least = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = least.select(F.col("component").alias("id"), "component").distinct()
    return least.unionByName(roots)
