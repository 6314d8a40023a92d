"""Connected components of a graph of long ids, by alternating stars.

Each round is two joins with pre-aggregated minima; links and labels are written to the shared
folder after every round and never gathered. Stars shrink paths to their smallest member, so the
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.base import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to the least of u and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The minima are stored so that Spark can split a hub with many links in the join.
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """u and every smaller neighbour of it go to the least of them; links have u > v."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    parts = [F.sum(h.bitwiseAND(0xFFFFFF)), F.sum(F.shiftrightunsigned(h, 40))]
    return tuple(links.agg(F.count(F.lit(1)), *parts).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids with a link; the component is the smallest id that can be reached.

    ``links`` has two long columns u and v; links of an id to itself and repeated links are ignored.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = stored(ordered.filter("u <> v").distinct(), "links")
    state = _state(links)
    while True:
        links = stored(_small_star(stored(_large_star(links), "links")), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    # At the end every link leads from an id to its component.
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
