"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import Store


def components(links: DataFrame, store: Store, name: str) -> DataFrame:
    """vertex, component (its smallest vertex) for every end of `links` (a, b).

    Alternates two steps that keep the components: all larger neighbours of a vertex are linked to its
    smallest neighbour, then all smaller ones. Each round is written; it ends when nothing changes.
    Smallest neighbours are found by aggregation, so a vertex with very many links is reduced in the
    tasks that hold them.
    """
    edges = store.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0")
    seen, turn = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        wide = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        wide = wide.where("u <> v").distinct()
        small = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = store.put(near.union(small.select("u", F.col("m").alias("v"))).distinct(), f"{name}{turn + 1}")
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
        store.drop(f"{name}{turn}")
        edges, turn = after, turn + 1
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
