"""Connected components of a graph whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.base import cut


def _least(links: DataFrame) -> DataFrame:
    """u, m: the least neighbour of each node, itself included."""
    return links.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())


def components(links: DataFrame) -> DataFrame:
    """node, comp: the least node reachable from each node of ``links`` (a, b; nulls and loops link nothing).

    Alternating large and small stars: every round joins nodes to lesser neighbours only, until all links point at
    the least node of their component; each round is written to the checkpoint folder.  The least neighbours come
    from partial aggregates and a join, so a node with very many links is split like any other skewed join key.
    """
    now = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(now)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
