"""Label and node statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.fragments import node_set


def label_frequency(edges: DataFrame) -> DataFrame:
    """Share of rows per label, ascending. Labels are counted once; the total is the sum of their counts."""
    counts = edges.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    shares = counts.select("label", (F.col("_n").cast("double") / total).alias("share"))
    return shares.orderBy("share", "label")


def label_frequency_above(edges: DataFrame, share: float) -> DataFrame:
    return label_frequency(edges).where(F.col("share") > share)


def label_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count_distinct("label").alias("labels"))


def node_count(edges: DataFrame) -> DataFrame:
    return node_set(edges).agg(F.count(F.lit(1)).alias("nodes"))


def query_filter(lines: DataFrame, column: str, marker: str = "<<0>>") -> DataFrame:
    """Query lines without ``marker``."""
    return lines.where(~F.col(column).contains(marker))
