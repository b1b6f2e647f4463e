"""Single steps of a path query on edges ``(src, label, dst)`` and states ``(origin, node, q)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.automaton import START, Automaton
from pathweave.session import small


def label_scan(edges: DataFrame, labels) -> DataFrame:
    """Edges with one of ``labels``; the predicate reaches a parquet scan below."""
    return edges.where(F.col("label").isin(list(labels)))


def label_scan_sources(edges: DataFrame, labels) -> DataFrame:
    return label_scan(edges, labels).select("src", "label").distinct()


def key_lookup(nodes: DataFrame, edges: DataFrame, labels=None) -> DataFrame:
    """Edges leaving the given nodes (column ``node``), optionally with one of ``labels``."""
    edges = edges if labels is None else label_scan(edges, labels)
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def start_transitions(transitions: DataFrame) -> DataFrame:
    return transitions.where(F.col("q") == START)


def frontier_labels(transitions: DataFrame, current: DataFrame) -> DataFrame:
    """Transitions that can follow those in ``current``: their labels are all the next step has to read."""
    reached = current.select(F.col("t").alias("q")).distinct()
    return transitions.join(reached, "q", "left_semi").distinct()


def product_edges(edges: DataFrame, automaton: Automaton) -> DataFrame:
    """Moves ``(src, q) -> (dst, t)`` of the graph and the automaton together."""
    steps = automaton.to_df(edges.sparkSession)
    moves = label_scan(edges, automaton.labels).join(small(steps, len(automaton.transitions)), "label")
    return moves.select("src", "q", "dst", "t").distinct()


def product_start(product: DataFrame) -> DataFrame:
    """First frontier: one edge from the start state."""
    first = product.where(F.col("q") == START)
    return first.select(F.col("src").alias("origin"), F.col("dst").alias("node"), F.col("t").alias("q")).distinct()


def next_states(frontier: DataFrame, product: DataFrame, visited: DataFrame) -> DataFrame:
    """States one move after ``frontier`` that are not visited."""
    moves = product.withColumnsRenamed({"src": "node"})
    reached = frontier.join(moves, ["node", "q"]).select("origin", F.col("dst").alias("node"), F.col("t").alias("q"))
    return reached.distinct().join(visited, ["origin", "node", "q"], "left_anti")


def next_states_from_ids(ids: DataFrame, product: DataFrame, visited: DataFrame) -> DataFrame:
    """``(node, q)`` one move after any of ``ids``, using only moves that leave a visited ``(node, q)``."""
    moves = product.join(ids.select(F.col("node").alias("src")), "src", "left_semi")
    left = visited.select(F.col("node").alias("src"), "q")
    moves = moves.join(left, ["src", "q"], "left_semi")
    return moves.select(F.col("dst").alias("node"), F.col("t").alias("q")).distinct()


def final_answers(states: DataFrame, final: int) -> DataFrame:
    return states.where(F.col("q") == final).drop("q").distinct()
