"""Labelled graphs derived from the order, line and event tables, and their stored form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathweave.functions.keyed import hot_keys
from pathweave.functions.rank import global_rank
from pathweave.session import parts_for, scratch_path
from pathweave.sources.text import store_edges


def successor(df: DataFrame, key: list[str], order: list[str], value: str, steps: int = 1) -> DataFrame:
    """``df`` with ``next``: ``value`` of the row ``steps`` later in ``order`` among rows of the same ``key``.

    A window per key, which moves every row once. Keys with more than a partition's share of the rows, counted before,
    go through global positions instead: a key with a third of all rows is no single task.
    """
    for c in key:
        df = df.where(F.col(c).isNotNull())
    rows = df.count()
    hot = hot_keys(df, key, rows, parts_for(df.sparkSession, rows), "_shares")
    if hot is None:
        return _in_keys(df, key, order, value, steps)
    hot = F.broadcast(hot.select(*key))
    calm = _in_keys(df.join(hot, key, "left_anti"), key, order, value, steps)
    return calm.unionByName(_by_position(df.join(hot, key, "left_semi"), key, order, value, steps))


def _in_keys(df: DataFrame, key: list[str], order: list[str], value: str, steps: int) -> DataFrame:
    here = Window.partitionBy(*key).orderBy(*order)
    # told from the row's place: the value itself may be null
    rows = df.withColumn("next", F.lead(F.struct(value), steps).over(here)).where(F.col("next").isNotNull())
    return rows.withColumn("next", F.col(f"next.{value}"))


def _by_position(df: DataFrame, key: list[str], order: list[str], value: str, steps: int) -> DataFrame:
    ranked = global_rank(df, [*key, *order], "_at")
    later = ranked.select((F.col("_at") - steps).alias("_at"), *(F.col(c).alias(f"_{c}") for c in key), F.col(value).alias("next"))
    same = ranked.join(later, "_at")
    for c in key:
        same = same.where(F.col(c) == F.col(f"_{c}"))
    return same.drop("_at", *(f"_{c}" for c in key))


def _edges(steps: DataFrame, src: str, label: Column) -> DataFrame:
    return steps.select(F.col(src).alias("src"), label.alias("label"), F.col("next").alias("dst"))


def part_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Consecutive parts of an order, labelled by the first one's quantity."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    items = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return _edges(successor(items, ["l_orderkey"], order, "l_partkey"), "l_partkey", F.col("l_quantity").cast("int"))


def handoff(spark: SparkSession, folder: str) -> DataFrame:
    """The user of the same day's next event, labelled by the event's ``k``."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    events = events.select("event_id", "ts", "user_id", F.to_date("ts").alias("day"),
                           F.get_json_object("props", "$.k").cast("int").alias("k"))
    return _edges(successor(events, ["day"], ["ts", "event_id"], "user_id"), "user_id", F.col("k"))


def order_follow(spark: SparkSession, folder: str) -> DataFrame:
    """An order to the customer's next order (label 1) and the one after it (label 2): a sparse graph."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey")
    ahead = [
        _edges(successor(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", n), "o_orderkey", F.lit(n))
        for n in (1, 2)
    ]
    return ahead[0].unionByName(ahead[1])


# Edges may repeat here; the store keeps each once.
_GRAPHS = {"part_chain": part_chain, "handoff": handoff, "order_follow": order_follow}
_TABLES = {"part_chain": "lineitem", "handoff": "events", "order_follow": "orders"}
_stored: dict[tuple, str] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Number, newest change and size of a table's files, from a listing: contents aren't read."""
    files = spark.read.format("binaryFile").load(path)
    return tuple(files.agg(F.count(F.lit(1)), F.max("modificationTime"), F.sum("length")).first())


def graph_key(spark: SparkSession, folder: str, name: str) -> tuple:
    """Tells a derived graph from those of other applications, folders and states of its table."""
    return spark.sparkContext.applicationId, folder, name, _state(spark, f"{folder}/{_TABLES[name]}.parquet")


def graph(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The edges of a derived graph from its parquet store, which is written at first use in an application and again
    when a file of its table has changed."""
    key = graph_key(spark, folder, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        store_edges(_GRAPHS[name](spark, folder), path)
        _stored[key] = path
    return spark.read.schema("src bigint, label int, dst bigint").parquet(_stored[key])
