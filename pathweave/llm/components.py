"""Connected components of a graph whose links are rows ``(a, b)``, by alternating star rounds.

Every round hangs the neighbours of a node on the smallest of them, first the larger ones, then the smaller ones, so links
turn into stars around the smallest member in a number of rounds that grows with the logarithm of a component's width.
A round is counts and minima that combine before the shuffle, and joins whose frequent keys adaptive execution splits;
a component of a third of all nodes is never one group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import Store, settle


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node that has a link: ``root`` is the smallest node of its component."""
    turned = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))  # with the count: did a round change anything?
    # written tables: a round joins the links with minima of themselves, and checkpoints would square its size estimate
    tables = Store(links.sparkSession, "links")
    links, seen = tables.put(turned, mark=mark)
    while seen["rows"]:
        before = seen
        hung, _ = tables.put(_larger(links))
        links, seen = tables.put(_smaller(hung), mark=mark)
        tables.keep(links)
        if seen == before:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _larger(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours, hung on the smallest of its neighbours and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("at"), F.least("a", "least").alias("least"))
    least, _ = settle(least)  # so that the join deals out both sides and frequent keys can be split
    hung = links.join(least, links.a == least["at"])  # the larger neighbours of a are the b of its links
    return hung.select(F.col("least").alias("a"), "b").distinct()


def _smaller(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, hung on the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("least")).withColumnRenamed("b", "at")
    least, _ = settle(least)
    hung = links.join(least, links.b == least["at"]).select(F.col("least").alias("x"), F.col("a").alias("y"))
    own = least.select(F.col("least").alias("x"), F.col("at").alias("y"))
    return hung.unionByName(own).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
