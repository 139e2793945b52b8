"""Connected components of a graph given as a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.durable import durable

ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("root"))
    down = links.join(least, "a").filter("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return down.union(least.select("a", F.col("root").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``, root being the smallest node that it reaches.

    No neighbourhood is gathered: a round is two minima, combined before the
    shuffle, each joined back to the links.  The links of every round are
    written to the shared checkpoint folder, so lineage stays short and lost
    executors cost one round.  Links from a node to itself and repeated links are
    harmless; without links the result is empty.
    """
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    state, before = durable(down, "links"), None
    for _ in range(ROUNDS):
        count = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if count == before or not count[0]:
            break
        before = count
        # larger node first, so that small-star's "smaller neighbours" are all b of an a
        turned = _large_star(state).filter("a <> b").distinct()
        state = durable(_small_star(turned).filter("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = state.select(F.col("b").alias("a"), "b").distinct()
    return state.union(roots).select(F.col("a").alias("node"), F.col("b").alias("root"))
