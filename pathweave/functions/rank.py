"""A global row number without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.session import settle

# monotonically_increasing_id() puts the partition number above this many bits of row number.
ROW_BITS = 33


def global_rank(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with its 0-based position in ``order`` (which must not leave ties that matter).

    A range sort numbers the rows inside each partition; adding the sizes of the partitions before gives the position.
    Only those sizes, one row per partition, pass through one task.
    """
    ordered, _ = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", ROW_BITS)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ordered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    row = F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    return ordered.withColumn(name, F.col("_offset") + row).drop("_id", "_part", "_offset")
