"""Edge sets and their packed, exported and deduplicated forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.rank import global_rank
from pathweave.session import settle, small


# Destinations one packed row may hold.
LONGEST_LIST = 1_000_000


def pack(edges: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """One row per ``(src, label, piece)`` with its destinations, sorted. The key's piece ``i`` holds the destinations
    from the ``i * longest``-th on, so only hubs have others than piece 0."""
    return _packed(edges, F.col("dst"), longest)


def pack_flagged(flagged: DataFrame, longest: int = LONGEST_LIST) -> DataFrame:
    """Packed rows whose destinations carry the flag ``local``."""
    return _packed(flagged, F.struct("dst", "local"), longest)


def _packed(edges: DataFrame, item: Column, longest: int) -> DataFrame:
    key = ["src", "label"]
    # at most one key per `longest` edges, found by counts that combine before the shuffle
    long = edges.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > longest).select(*key)
    long, seen = settle(long)
    pieces = edges.join(small(long, seen), key, "left_anti").withColumn("piece", F.lit(0))
    if seen["rows"]:
        # only such keys are put in order
        ranked = global_rank(edges.distinct().join(small(long, seen), key, "left_semi"), [*key, "dst"], "_at")
        first = ranked.groupBy(*key).agg(F.min("_at").alias("_first"))
        piece = F.floor((F.col("_at") - F.col("_first")) / longest).cast("int")
        ranked = ranked.join(small(first, seen), key).withColumn("piece", piece)
        pieces = pieces.unionByName(ranked.drop("_at", "_first"))
    return pieces.groupBy(*key, "piece").agg(F.sort_array(F.collect_set(item)).alias("dsts"))


def unpack(adjacency: DataFrame) -> DataFrame:
    return adjacency.select("src", "label", F.explode("dsts").alias("dst"))


def pack_text(adjacency: DataFrame) -> DataFrame:
    """Destinations as text joined by colons; flagged structs ``(dst, local)`` as ``dst-1`` or ``dst-0``."""
    item = adjacency.schema["dsts"].dataType.elementType
    words = F.col("dsts").cast("array<string>")
    if item.typeName() == "struct":
        words = F.transform("dsts", lambda d: F.concat_ws("-", d["dst"].cast("string"), d["local"].cast("int")))
    return adjacency.withColumn("dsts", F.array_join(words, ":"))


def unpack_text(adjacency: DataFrame) -> DataFrame:
    """Edges from colon-joined text; a locality flag after the destination is dropped."""
    each = adjacency.select("src", "label", F.explode(F.split("dsts", ":")).alias("word"))
    return each.select("src", "label", F.substring_index("word", "-", 1).cast("bigint").alias("dst"))


def sink_nodes(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Ids of ``0..n_nodes-1`` without an outgoing edge."""
    ids = edges.sparkSession.range(n_nodes).select(F.col("id").alias("node"))
    return ids.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def graph_size(edges: DataFrame) -> DataFrame:
    """Number of packed rows, that is distinct ``(src, label)``."""
    return edges.select("src", "label").distinct().agg(F.count(F.lit(1)).alias("packed_rows"))


def undirected_lines(edges: DataFrame, n_nodes: int, longest: int = LONGEST_LIST) -> DataFrame:
    """Adjacency lines of nodes ``1..n_nodes``: neighbours of either direction in order, repeated as often as there are
    edges; empty where there are none. ``(node, piece, line)``: a hub's line is cut into pieces of ``longest`` neighbours.
    """
    out = edges.select((F.col("src") + 1).alias("node"), (F.col("dst") + 1).alias("near"))
    back = edges.select((F.col("dst") + 1).alias("node"), (F.col("src") + 1).alias("near"))
    ranked = global_rank(out.unionByName(back), ["node", "near"], "_at")
    first = ranked.groupBy("node").agg(F.min("_at").alias("_first"))
    piece = F.floor((F.col("_at") - F.col("_first")) / longest).cast("int").alias("piece")
    near = F.sort_array(F.collect_list("near")).cast("array<string>")
    lines = ranked.join(first, "node").groupBy("node", piece).agg(F.array_join(near, " ").alias("line"))
    ids = edges.sparkSession.range(1, n_nodes + 1).select(F.col("id").alias("node"))
    full = ids.join(lines, "node", "left")
    return full.select("node", F.coalesce("piece", F.lit(0)).alias("piece"), F.coalesce("line", F.lit("")).alias("line"))


def write_undirected_lines(edges: DataFrame, n_nodes: int, path: str, longest: int = LONGEST_LIST) -> None:
    """One text line per node in node order, neighbours parted by blanks. A blank ends every written piece and a new line
    begins every node but the first, so a hub's line is written from as many rows as it has pieces."""
    lines, _ = settle(undirected_lines(edges, n_nodes, longest))
    begins = (F.col("piece") == 0) & (F.col("node") > 1)
    text = F.concat(F.when(begins, "\n").otherwise(""), F.col("line"))
    lines.orderBy("node", "piece").select(text.alias("value")).write.text(path, lineSep=" ")


def last_write_wins(edges: DataFrame, sequence: list[str]) -> DataFrame:
    """One destination per ``(src, label)``: the one latest in ``sequence`` (columns or expressions)."""
    latest = F.max_by("dst", F.struct(*sequence))
    return edges.groupBy("src", "label").agg(latest.alias("dst"))
