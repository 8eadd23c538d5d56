"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landshift.llm.storage import discard, store


def _links(df: DataFrame) -> DataFrame:
    return store(df.where("u != v").distinct())


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", "u"))).first())


def _low(links: DataFrame) -> DataFrame:
    """Smallest neighbour-or-self of each u, written so that the join with it can split a popular u."""
    return store(links.groupBy("u").agg(F.least("u", F.min("v")).alias("low")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b); root is the smallest node of the component.

    Each round links every node to the smallest node it knows of; the number of
    rounds grows with the logarithm of the component sizes. A hub's links are
    folded to one minimum inside the tasks before they meet.
    """
    now = _links(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _low(both)
        large = _links(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")))
        discard(low, now)
        low = _low(large)
        now = _links(
            large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(low.select("u", F.col("low").alias("v")))
        )
        discard(low, large)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
