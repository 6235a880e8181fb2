"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_keys, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every linked node with the smallest node id reachable from it.

    Alternating large-star and small-star steps (each a min per node and a join, in which the links of a node of very many can be split) until the links form stars;
    the links are written to the shared folder after each round, so a lost executor costs one round at most.
    An empty link table gives an empty result; self links and nulls are ignored; repeated links count once.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges)
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_keys(both, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_keys(large, low, ["u"])
        small = small.select("u", "m").union(small.select(F.col("v").alias("u"), "m")).where("u <> m")
        edges = stored(small.select("u", F.col("m").alias("v")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    top = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return top.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
