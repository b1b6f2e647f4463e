"""What every job needs from the session: a durable checkpoint folder, sizes, and scoped settings for loops."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows and bytes a table may have to be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16_000_000
# Static rows (edges) below which a loop is all fixed cost and takes few partitions.
FEW_ROWS = 250_000
# Static rows and accumulated rows (search states) wanted per partition: near 128 MB, a row being a few numbers wide.
EDGES_PER_PART = 4_000_000
STATES_PER_PART = 4_000_000
# A key below this many rows is never hot.
HOT_ROWS = 100_000

_ROOT = str(Path(__file__).resolve().parents[1])


def reachable(df: DataFrame) -> DataFrame:
    """``df``, with the package's folder on the workers' path.

    Workers take the driver's environment but not its ``sys.path``. A cluster whose machines don't have that folder
    needs the package installed, or given by ``--py-files``.
    """
    environment = df.sparkSession.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that survives executors: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    sc = spark.sparkContext
    set_already = sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not set_already:
            sc.setCheckpointDir(configured)
        return configured
    if set_already:
        return set_already
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pathweave-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _width(df: DataFrame) -> Column:
    """Bytes of a row: what its strings hold, elements of its arrays, and eight for anything else."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        kind, column = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind == "array":
            total = total + 8 * F.greatest(F.size(column), F.lit(0))
    return total + F.lit(8 * len(df.columns))


def _observed(df: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    seen = Observation()
    known = {"rows": F.count(F.lit(1)), "bytes": F.coalesce(F.sum(_width(df)), F.lit(0))}
    return df.observe(seen, *(c.alias(name) for name, c in (known | metrics).items())), seen


def settle(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Checkpoint ``df`` and return it with its ``rows``, ``bytes`` and ``metrics``, all measured by the one writing job.

    A checkpoint keeps partitioning and order, and also the size *estimate* of the plan it replaces. A loop that joins a
    table with one made from itself squares that estimate in each round; such loops use :func:`store`.
    """
    checkpoint_dir(df.sparkSession)
    observed, seen = _observed(df, metrics)
    stored = observed.checkpoint(eager=True)
    return stored, seen.get


class Store:
    """The tables of a loop, written to the shared folder: their estimates are the sizes of their files, whatever they
    were made from. The loop says which of them it still needs; the others are deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.made: list[tuple[DataFrame, str]] = []

    def put(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        path = scratch_path(self.spark, self.name)
        observed, seen = _observed(df, metrics)
        observed.write.parquet(path)
        stored = self.spark.read.schema(df.schema).parquet(path)
        self.made.append((stored, path))
        return stored, seen.get

    def keep(self, *tables: DataFrame | None) -> None:
        """Delete all tables but these; nothing that is still to run may read them."""
        for table, path in self.made:
            if not any(table is t for t in tables):
                remove(self.spark, path)
        self.made = [m for m in self.made if any(m[0] is t for t in tables)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(table: DataFrame) -> None:
    """Delete the files of a checkpoint; nothing that is still to run may read it."""
    held = table._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if held.isDefined():
        remove(table.sparkSession, held.get())


def store(df: DataFrame, name: str = "table", **metrics: Column) -> tuple[DataFrame, dict]:
    """As :func:`settle`, by a written table, for loops that join tables with themselves."""
    return Store(df.sparkSession, name).put(df, **metrics)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a loop over ``rows`` static rows: few for a small input, whose rounds are all fixed cost, else by
    size and at least one per core."""
    cores = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if rows <= min(FEW_ROWS, EDGES_PER_PART):
        return min(cores, 4)
    return max(cores, math.ceil(rows / EDGES_PER_PART))


def small(df: DataFrame, seen: dict | int) -> DataFrame:
    """Broadcast hint for a table of measured size, given as what :func:`settle` saw, or as rows where a row is a few
    numbers; larger ones are left to a shuffle join."""
    rows, size = (seen, 0) if isinstance(seen, int) else (seen["rows"], seen["bytes"])
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


@contextmanager
def loop_settings(spark: SparkSession, parts: int):
    """Settings for jobs that depend on fixed partitioning.

    A checkpoint keeps the partitioning and order of its plan only if the plan is final when it starts, so adaptive
    re-planning is off inside loops: edges and visited states then stay where they are and only new rows move. What
    adaptive execution would add is done here from measured row counts: partition number, broadcasts, hot keys.
    """
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # A bloom filter on the frontier would read all stored edges once more per round.
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "false",
        "spark.sql.shuffle.partitions": str(parts),
        # A table partitioned by some of a join's keys may stay where it is.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
