"""A static table laid out once by key, so that loop rounds join to it without moving it, whatever the key skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import HOT_ROWS, discard, settle

SALT = "_salt"
# Buckets in which keys are counted together before they are told apart.
BUCKETS = 65_536


def hot_keys(df: DataFrame, keys: list[str], rows: int, parts: int, shares: str) -> DataFrame | None:
    """Keys holding more than a partition's share of ``df``, with the number of shares to cut them into.

    There are fewer than ``parts`` of them whatever the data, which makes the table safe to broadcast. Rows are counted by
    a hash of the key first, which moves a number of rows that doesn't grow; only keys in crowded buckets are told apart.
    """
    limit = max(HOT_ROWS, rows // parts)
    if rows <= limit:
        return None
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    crowded = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    held = [r[0] for r in crowded.select("_bucket").collect()]  # fewer than parts
    if not held:
        return None
    counts = df.where(bucket.isin(held)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    table, seen = settle(counts.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias(shares)))
    return table if seen["rows"] else None


class Keyed:
    """``df`` partitioned and sorted by ``keys``; the rows of a hot key are spread by a hash of ``spread``."""

    def __init__(
        self, df: DataFrame, keys: list[str], spread: list[str], rows: int, parts: int, lay: bool = True, hot: DataFrame | None = None
    ):
        """``lay=False`` for a table that is read for one join only: it is dealt out by that join, with ``hot`` its hot keys
        as :func:`hot_keys` finds them."""
        self.keys, self.spread, self.rows, self.parts = keys, spread, rows, parts
        self.hot = hot_keys(df, keys, rows, parts, "_shares") if lay else hot
        self.on = keys + ([SALT] if self.hot is not None else [])
        if self.hot is not None:
            shares = F.coalesce("_shares", F.lit(1))
            salt = F.pmod(F.xxhash64(*spread), shares).cast("int")
            df = df.join(F.broadcast(self.hot), keys, "left").withColumn(SALT, salt).drop("_shares")
        if lay:
            self._lay(df, parts)
        else:
            self.table = df

    def _lay(self, df: DataFrame, parts: int) -> None:
        self.parts = parts
        self.table = df.repartition(parts, *self.on).sortWithinPartitions(*self.on).checkpoint(eager=True)

    def relay(self, parts: int) -> None:
        before = self.table
        self._lay(before, parts)
        discard(before)

    def _copies(self, probe: DataFrame) -> DataFrame:
        """One copy of a probing row per share of its key, so that it meets all rows of that key."""
        if self.hot is None:
            return probe
        probe = probe.join(F.broadcast(self.hot), self.keys, "left")
        copies = F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)
        return probe.withColumn(SALT, F.explode(copies)).drop("_shares")

    def lookup(self, probe: DataFrame, how: str) -> DataFrame:
        """Join on ``keys`` and ``spread`` together: one row of the table at most, in one known share of its key."""
        if self.hot is not None:
            shares = F.coalesce("_shares", F.lit(1))
            salt = F.pmod(F.xxhash64(*self.spread), shares).cast("int")
            probe = probe.join(F.broadcast(self.hot), self.keys, "left").withColumn(SALT, salt).drop("_shares")
        return self._unsalted(probe.join(self.table, self.on + self.spread, how))

    def join(self, probe: DataFrame, probe_rows: int = 0) -> DataFrame:
        """Inner join on ``keys``. Only ``probe`` is shuffled.

        With ``probe_rows`` given, keys that are hot among the probing rows (many origins on one node) are cut as well:
        their static rows are repeated once per share. A hot key yields one output row per probing and static row, and
        a share holds at least ``HOT_ROWS`` probing rows, so the repeated rows are a tiny part of the output.
        """
        busy = hot_keys(probe, self.keys, probe_rows, self.parts, "_cuts") if probe_rows else None
        if busy is None:
            return self._unsalted(self._copies(probe).join(self.table, self.on))
        busy = F.broadcast(busy)
        calm = self._copies(probe.join(busy, self.keys, "left_anti")).join(self.table, self.on)
        others = [c for c in probe.columns if c not in self.keys]
        cut = F.pmod(F.xxhash64(*others), F.col("_cuts")).cast("int")
        hot_probe = self._copies(probe.join(busy, self.keys).withColumn("_cut", cut).drop("_cuts"))
        every_cut = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
        hot_table = self.table.join(busy, self.keys).withColumn("_cut", every_cut).drop("_cuts")
        crowded = hot_probe.join(hot_table, self.on + ["_cut"]).drop("_cut")
        return self._unsalted(calm.unionByName(crowded))

    def _unsalted(self, df: DataFrame) -> DataFrame:
        return df if self.hot is None else df.drop(SALT)
