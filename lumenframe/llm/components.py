"""Connected components by alternating large and small stars, without collecting links anywhere.

Defined results: links without one of their ends, loops and repeats count for nothing; nodes
without a link, and roots, have no row; no links give no rows; other columns don't matter. A
node with very many links is a hot key of the joins by it: its links are counted once for each
task before they are shuffled, and adaptive execution splits what is joined with its least one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _least(links: DataFrame) -> DataFrame:
    """(u, least neighbour of u, u among them)."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("center"), F.least("u", "m").alias("m"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    both = _both_ways(links)
    return both.join(_least(both), F.col("u") == F.col("center")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _least(links)
    joined = links.join(least, F.col("u") == F.col("center")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionAll(least.select(F.col("center").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node with a link, but for the roots: the least node that it reaches. links: (u, v) in any order, repeats and loops allowed.

    Every round is stored in the shared folder; the number of rounds grows with the logarithm of the nodes.
    """
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "links")
    before = _digest(links)
    while before[0]:
        links = stored(_small_star(_large_star(links)), "stars")
        now = _digest(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
