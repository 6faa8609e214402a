"""Connected components of a set of links, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_totals


def _mark(links: DataFrame) -> tuple:
    """A mark of a set of links that changes when the set does."""
    row = links.agg(
        F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40)))
    ).first()
    return tuple(row)


def _star(links: DataFrame, large: bool, number: int) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them (Kiveris et al., large star and small star).

    The node that most hang on already, a root, has its neighbours spread over all tasks.
    """
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
    joined = join_totals(near, least, "a", "_n", number)
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component."""
    links = checkpointed(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while mark[0]:
        large = checkpointed(_star(links, True, 2 * mark[0]))
        links = checkpointed(_star(large, False, mark[0]))
        mark, last = _mark(links), mark
        if mark == last:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
