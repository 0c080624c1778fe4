"""Connected components of a table of links, by rounds of large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from curbside.sources.staging import stage


def _oriented(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def connected_components(links: DataFrame, most: int = 100) -> DataFrame:
    """node and component (its smallest node) for every node of `links` (two bigint columns).

    Direction, repeated links and links of a node to itself do not matter; links with a null are left out.
    In each round every node hands its larger neighbours, then its smaller ones, to the smallest node it
    knows, until all links point at the smallest node of their component. The rounds grow with the logarithm
    of the longest path. Each round is a table in the shared folder, so a lost executor costs no earlier round.
    """
    first, second = links.columns[:2]
    plain = links.select(F.col(first).cast("bigint").alias("a"), F.col(second).cast("bigint").alias("b"))
    edges = stage(plain.where("a <> b").select(*_oriented("a", "b")).distinct(), "links")
    loops = stage(plain.where("a = b").select(F.col("a").alias("u")).distinct(), "loops")
    before = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        # large star: each larger neighbour of u, that is the upper end of an edge whose lower end is u
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select(F.col("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large-star")
        # small star: the smaller neighbours of u, and u itself
        lower = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        own = lower.select("u", F.col("m").alias("v"))
        edges = stage(small.unionByName(own).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the components are not found after {most} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.join(edges, "u", "left_anti").join(roots.select(F.col("node").alias("u")), "u", "left_anti")
    return stage(nodes.unionByName(roots).unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("component"))), "components")
