"""The loop all path queries share: expand the frontier, keep what is new, until nothing is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.session import STATES_PER_PART, discard, loop_settings, settle

# Runs of visited states that a round compares with before they are merged into one.
MAX_RUNS = 4


class Visited:
    """All states found so far, as runs partitioned and sorted alike.

    A round subtracts the runs one after the other by merge joins that need neither shuffle nor sort. Runs that were merged
    into others are deleted once the round after them is done, which may still read them.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.runs: list[tuple[DataFrame, int, frozenset]] = []
        self.rows = 0
        self.merged: list[DataFrame] = []

    def add(self, run: DataFrame, rows: int, tags: frozenset) -> None:
        self.runs.append((run, rows, tags))
        self.rows += rows
        if len(self.runs) > MAX_RUNS:
            self._merge()

    def _merge(self) -> None:
        """Merge the youngest runs, and older ones while they are not much larger: each row is rewritten O(log) times."""
        take, total = 1, self.runs[-1][1]
        while take < len(self.runs) and (take < MAX_RUNS // 2 or self.runs[-take - 1][1] <= 2 * total):
            take += 1
            total += self.runs[-take][1]
        young = self.runs[-take:]
        self.runs = self.runs[:-take] + [(self._lay(young, None), total, frozenset().union(*(r[2] for r in young)))]
        self.merged += [r[0] for r in young]

    def _lay(self, runs, parts: int | None) -> DataFrame:
        table = reduce(DataFrame.unionByName, (r[0] for r in runs))
        by = [F.col(k) for k in self.keys]
        table = table.repartition(parts, *by) if parts else table.repartition(*by)
        return table.sortWithinPartitions(*self.keys).checkpoint(eager=True)

    def drop_merged(self) -> None:
        for run in self.merged:
            discard(run)
        self.merged = []

    def relay(self, parts: int) -> None:
        self.merged += [r[0] for r in self.runs]
        self.runs = [(self._lay(self.runs, parts), self.rows, frozenset().union(*(r[2] for r in self.runs)))]

    def new(self, candidates: DataFrame, tags: frozenset) -> DataFrame:
        """Candidates not visited, sorted as merge joins leave them. Runs without any of their tags are not read."""
        runs = [run for run, _, held in self.runs if held & tags]
        for run in runs:
            candidates = candidates.join(run, self.keys, "left_anti")
        return candidates if runs else candidates.sortWithinPartitions(*self.keys)

    def table(self, tags: frozenset | None = None) -> DataFrame | None:
        runs = [run for run, _, held in self.runs if tags is None or held & tags]
        return reduce(DataFrame.unionByName, runs) if runs else None


def fixpoint(
    spark: SparkSession,
    seed: DataFrame,
    expand: Callable[[DataFrame, int, frozenset], DataFrame],
    keys: list[str],
    parts: int,
    first: frozenset = frozenset({0}),
    follow: Callable[[frozenset], frozenset] = lambda tags: tags,
    relay: Callable[[int], None] = lambda parts: None,
    max_rounds: int | None = None,
) -> Visited:
    """States reachable from ``seed`` by ``expand(frontier, rows, tags)``, which gives the columns ``keys``, all of a state.

    ``first`` and ``follow`` say which tags (automaton states) the first and the next frontier can carry: a round whose
    tags never occurred before subtracts nothing, and the loop ends without a probing job when no tag is left.
    ``relay(parts)`` is called when states outgrow the partitions and everything moves to more of them.
    """
    visited, tags, rounds = Visited(keys), first, 0
    with loop_settings(spark, parts):
        frontier = seed.select(*keys).distinct().sortWithinPartitions(*keys)
        while True:
            frontier, seen = settle(frontier)
            visited.drop_merged()
            rows = seen["rows"]
            if not rows:
                return visited
            rounds += 1
            if max_rounds is not None and rounds > max_rounds:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
            visited.add(frontier, rows, tags)
            following = follow(tags)
            if not following:
                visited.drop_merged()
                return visited
            wanted = parts
            while visited.rows > wanted * STATES_PER_PART:
                wanted *= 4
            if wanted > parts:
                parts = wanted
                spark.conf.set("spark.sql.shuffle.partitions", str(parts))
                visited.relay(parts)
                relay(parts)
            frontier, tags = visited.new(expand(frontier, rows, tags).distinct(), following), following
