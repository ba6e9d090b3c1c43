"""Connected components of a table of links, by star contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithogrid.llm.common import Shared, join_by_size


def _star(links: DataFrame, shared: Shared, name: str, total: int) -> DataFrame:
    """Tie the neighbours v of each node u to the smallest of u and its neighbours.

    ``links`` has each u's neighbours to be tied, at most ``total`` rows; a node with a third of all
    links is served by ``join_by_size``, and the minimum is combined before it shuffles.
    """
    least = shared.save(links.groupBy("u").agg(
        F.least(F.min("v"), F.col("u")).alias("least"), F.count(F.lit(1)).alias("n")), f"{name}-least")
    return join_by_size(links, least.select("u", "least", "n"), "u", "n", total, F.col("v"))


def _standing(links: DataFrame) -> tuple[int, bool]:
    """How many distinct links (u, v), v < u, there are, and whether they are stars around each v alone."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    count, tied = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(
        F.max(F.when(F.col("up") > 0, F.col("up") + F.col("down"))), F.lit(0))).first()
    return count, tied <= 1


def components(links: DataFrame, shared: Shared) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node of its component.

    ``links``: (a, b) in any order and direction, repeats allowed. Large and
    small stars alternate until the links are stars around the roots, which
    is seen without another round; links that come as such stars need none.
    """
    links = shared.save(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links-0")
    step = 0
    count, done = _standing(links)
    while not done:
        step += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, shared, f"large-{step}", 2 * count).filter("v > u").select(
            F.col("v").alias("u"), F.col("least").alias("v")).filter("u > v").distinct()
        large = shared.save(large, f"large-{step}")
        small = _star(large, shared, f"small-{step}", count)  # a large star makes at most one link of each
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            small.select("u", F.col("least").alias("v"))).filter("u > v").distinct()
        links = shared.save(small, f"links-{step}")
        count, done = _standing(links)
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
