"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (summed before it shuffles) and an equi-join. The minima are
written before the join, so that both its sides come straight from a shuffle and adaptive
execution can split a node with very many links. Each step is written to the shared folder
and released when the next one stands. Nothing but two numbers per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, save


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
    moved = save(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "links")
    release(low)
    return moved


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = save(down.groupBy("u").agg(F.min("v").alias("m")), "low")
    moved = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = save(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    release(low)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long) that is not its component's smallest node."""
    links = save(links.filter("u <> v").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen or not state["n"]:
            return links.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        seen = (state["n"], state["s"])
        large = _large_star(links)
        release(links)
        links = _small_star(large)
        release(large)
