"""Connected components of a graph of links, by alternating large and small stars; nothing goes to the driver but sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables, name: str, a: str = "a", b: str = "b", *, rounds: int | None = None) -> DataFrame:
    """(id, component): for each id in a link, the smallest id that links reach. Loops and repeated links do no harm. name is for its
    tables. With so many rounds only, it need not be the smallest, but what has the same component is linked.

    Each round joins every id to the smallest id near it, until nothing changes; a round's edges are at most the links. Tables
    are written before each join, so both of its sides are plain exchanges, and adaptive execution can split the edges of an
    id that has very many.
    """
    edges = tables.keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), f"{name}-0")
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    total = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    k, before = 0, None if rounds else total(edges)
    while k != rounds:
        # each id's greater neighbours go to the least id near it
        lowest = tables.keep(both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{k}-near")
        large = both(edges).filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = tables.keep(large, f"{name}-{k}-large")
        # each id and its lesser neighbours go to the least of these
        lowest = tables.keep(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{k}-least")
        if not rounds and total(large) == before and lowest.count() == before[0]:
            break
        moved = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = tables.keep(moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k + 1}")
        edges, k = small, k + 1
        if not rounds:
            now = total(small)
            if now == before:
                break
            before = now
    ends = edges if not rounds else edges.groupBy("u").agg(F.min("v").alias("v"))
    roots = edges.select(F.col("v").alias("u")).distinct()
    roots = roots.join(ends, "u", "left_anti") if rounds else roots
    return tables.keep(ends.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("id"), F.col("u").alias("component"))), f"{name}-end")
