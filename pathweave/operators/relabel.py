"""New node ids that follow a partitioning. Id maps are tables ``(old_id, new_id)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.rank import global_rank
from pathweave.session import settle, small


def idmap_storage_order(fragment: DataFrame) -> DataFrame:
    """Ids in order, zipped with the ids in fragment order."""
    old = global_rank(fragment.select(F.col("node").alias("old_id")), ["old_id"], "at")
    return _zip(old, global_rank(fragment, ["part", "node"], "at"))


def idmap_by_partition(groups: DataFrame, fragment: DataFrame) -> DataFrame:
    """Nodes grouped by an outside partition ``(node, part)``, zipped with the nodes grouped by storage fragment.

    Both sides are in order of group size, group, node. Which groups meet depends on sizes only.
    """
    return _zip(_by_size(groups).withColumnRenamed("node", "old_id"), _by_size(fragment))


def idmap_by_group_size(groups: DataFrame, fragment: DataFrame) -> DataFrame:
    """Groups matched to fragments of equal size, in order where several have one size, and zipped inside. A group
    without a fragment of its size has no new ids."""
    old, new = _members(groups), _members(fragment)
    pairs = old.withColumnRenamed("node", "old_id").join(new.withColumnRenamed("node", "new_id"), ["size", "number", "at"])
    return pairs.select("old_id", "new_id")


def _sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("part").agg(F.count(F.lit(1)).alias("size"))


def _by_size(groups: DataFrame) -> DataFrame:
    sizes, seen = settle(_sizes(groups))
    return global_rank(groups.join(small(sizes, seen), "part"), ["size", "part", "node"], "at").select("node", "at")


def _members(groups: DataFrame) -> DataFrame:
    """``(node, size, number, at)``: nodes with their group's size, its number among groups of that size, and their
    position in it. A group may be a third of all nodes, so positions come from global ranks less first ones, not from
    windows, and the table of groups is settled, which lets the joins broadcast it or split a group's nodes."""
    sizes, seen = settle(_sizes(groups))
    ranked = global_rank(groups.join(small(sizes, seen), "part"), ["size", "part", "node"], "_at")
    firsts = ranked.groupBy("size", "part").agg(F.min("_at").alias("_first"))
    numbered = global_rank(firsts, ["size", "part"], "_number")
    lowest = numbered.groupBy("size").agg(F.min("_number").alias("_lowest"))
    numbered = numbered.join(lowest, "size").select("part", "_first", (F.col("_number") - F.col("_lowest")).alias("number"))
    numbered, _ = settle(numbered)
    placed = ranked.join(small(numbered, seen), "part")
    return placed.select("node", "size", "number", (F.col("_at") - F.col("_first")).alias("at"))


def _zip(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.withColumnRenamed("node", "new_id"), "at").select("old_id", "new_id")


def relabel_edges(edges: DataFrame, idmap: DataFrame) -> DataFrame:
    """Both ends through the map; a destination without a new id keeps its own, a source without one is an error."""
    for end, name in (("src", "_src"), ("dst", "_dst")):
        new = idmap.select(F.col("old_id").alias(end), F.col("new_id").alias(name))
        edges = edges.join(new, end, "left")
    unmapped = F.raise_error(F.concat(F.lit("an edge leaves a node without a new id: "), F.col("src").cast("string"))).cast("bigint")
    return edges.select(F.coalesce("_src", unmapped).alias("src"), "label", F.coalesce("_dst", "dst").alias("dst"))
