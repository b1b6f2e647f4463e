"""How a partition of the nodes into fragments cuts the graph. ``fragment`` is a table ``(node, part)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_set(edges: DataFrame) -> DataFrame:
    """Distinct ids over both ends."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
    return ends.distinct()


def fragment_assign(nodes: DataFrame, parts: int) -> DataFrame:
    """Fragment by id modulo ``parts``."""
    return nodes.select("node", F.pmod("node", F.lit(parts)).cast("int").alias("part"))


def fragment_ranges(nodes: DataFrame, parts: int, upper: int) -> DataFrame:
    """Fragment by equal id ranges of ``0..upper-1``, which keeps neighbouring ids together."""
    part = F.least(F.floor(F.col("node") * parts / upper), F.lit(parts - 1))
    return nodes.select("node", part.cast("int").alias("part"))


def fragment_sizes(fragment: DataFrame) -> DataFrame:
    return fragment.groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))


def with_parts(edges: DataFrame, fragment: DataFrame) -> DataFrame:
    """Edges with ``src_part`` and ``dst_part``, null for an end that no fragment holds.

    Plain equi-joins: hub ends make skewed keys of the edge side, which adaptive execution splits.
    """
    for end in ("src", "dst"):
        part = fragment.select(F.col("node").alias(end), F.col("part").alias(f"{end}_part"))
        edges = edges.join(part, end, "left")
    return edges


def _local() -> Column:
    """Both ends in one fragment; an end outside all fragments is local to none."""
    return F.coalesce(F.col("src_part") == F.col("dst_part"), F.lit(False))


def cross_edges(edges: DataFrame, fragment: DataFrame) -> DataFrame:
    """Edges whose ends lie in different fragments."""
    crossing = with_parts(edges, fragment).where(~_local())
    return crossing.select(*edges.columns)


def boundary_nodes(edges: DataFrame, fragment: DataFrame) -> DataFrame:
    """Nodes entered from another fragment."""
    ends = edges.select("src", "dst")
    return cross_edges(ends, fragment).select(F.col("dst").alias("node")).distinct()


def boundary_by_histogram(edges: DataFrame, fragment: DataFrame) -> DataFrame:
    """Nodes with fewer in-neighbours in their own fragment than in-neighbours; equals ``boundary_nodes``."""
    neighbours = with_parts(edges.select("src", "dst").distinct(), fragment)
    own = F.count_if(_local())
    counts = neighbours.groupBy(F.col("dst").alias("node")).agg(own.alias("own"), F.count(F.lit(1)).alias("degree"))
    return counts.where("own <> degree").select("node")


def locality_flags(edges: DataFrame, fragment: DataFrame) -> DataFrame:
    """Per edge: does it stay in its fragment?"""
    flagged = with_parts(edges, fragment)
    return flagged.select(*edges.columns, _local().alias("local"))


def boundary_flags(adjacency: DataFrame, boundary: DataFrame) -> DataFrame:
    """Per packed row: is its source a boundary node?"""
    marks = boundary.select(F.col("node").alias("src"), F.lit(True).alias("boundary"))
    return adjacency.join(marks, "src", "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))
