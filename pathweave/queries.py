"""Every operator run over the given tables: name -> function of (session, folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.automaton import Automaton
from pathweave.operators import fragments, gains, layout, relabel, signatures, stats, steps
from pathweave.plans import conjunctive, rpq, swaps
from pathweave.session import scratch_path
from pathweave.sources import text
from pathweave.sources.derived import graph, graph_key

R2 = Automaton.of("1 5 2; 2 6 2; 2 7 3")
R3 = Automaton.of("1 5 2; 1 6 2; 2 5 2; 2 6 2")
C2 = Automaton.of("1 8 2; 2 9 2; 2 10 2; 2 11 3")
BOTH = Automaton.of("1 5 2; 2 6 2; 2 7 4; 1 8 3; 3 9 3; 3 10 3; 3 11 4")
ORDERS = Automaton.of("1 1 2; 2 2 2; 2 1 3; 3 1 3")
PARTS = 3
LEVEL = 2
START_NODE = 17


_stored_by_source: dict[tuple, str] = {}


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder, "part_chain")


def _handoff(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder, "handoff")


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder, "order_follow")


def _n_nodes(edges: DataFrame) -> int:
    """Ids run from 0 without declared gaps."""
    return edges.agg(F.greatest(F.max("src"), F.max("dst")) + 1).first()[0]


def _thirds(edges: DataFrame) -> DataFrame:
    return fragments.fragment_assign(fragments.node_set(edges), PARTS)


def _ranges(edges: DataFrame) -> DataFrame:
    """Fragments of near ids."""
    return fragments.fragment_ranges(fragments.node_set(edges), PARTS, _n_nodes(edges))


def _colours(edges: DataFrame) -> DataFrame:
    return _thirds(edges).withColumnRenamed("part", "colour")


def _years(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("part"))


def _groups(edges: DataFrame) -> DataFrame:
    """An outside partition, blocks of eight ids dealt out in turn, read from its file of one group number per node."""
    path = scratch_path(edges.sparkSession, "groups")
    nodes = fragments.node_set(edges)
    text.write_numbered_lines(nodes.select("node", F.pmod(F.shiftright("node", 3), F.lit(PARTS)).cast("int").alias("part")), path, "part")
    return text.read_numbered_lines(edges.sparkSession, path, "part")


def _turned(edges: DataFrame) -> DataFrame:
    """Thirds by the next id, whose sizes are those of ``_thirds`` in another order."""
    return fragments.node_set(edges).select("node", F.pmod(F.col("node") + 1, F.lit(PARTS)).cast("int").alias("part"))


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(START_NODE,)], "node bigint")


def _sizes(n: int) -> list[int]:
    return [n // 3, n // 3, n - 2 * (n // 3)]


# --- sources, sinks, layout


def edge_list_load(spark, folder, order="sdl"):
    path = scratch_path(spark, "edges")
    text.write_edges(_chain(spark, folder), path, order)
    return text.read_edges(spark, path, order, "int")


def layered_edges_union(spark, folder):
    """Labels 1..50 in five layers of ten, stored as one CSV folder per layer with ids from 1."""
    path = scratch_path(spark, "layers")
    layer = F.least(F.lit(5), F.floor((F.col("label") - 1) / 10) + 1).cast("int")
    rows = _chain(spark, folder).select((F.col("src") + 1).alias("s"), (F.col("dst") + 1).alias("d"), layer.alias("layer"))
    rows.write.partitionBy("layer").csv(path)
    return text.read_layers(spark, {i: f"{path}/layer={i}" for i in range(1, 6)})


def _automaton_file(spark, folder):
    """The part graph written as an automaton: part ``p`` is state ``p + 1``; the start node is the smallest id that a
    label 5 leaves."""
    edges, path = _chain(spark, folder), scratch_path(spark, "automaton")
    lines = edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "label").alias("value"))
    states = F.greatest(F.max("src"), F.max("dst")) + 1
    header = edges.agg(F.concat_ws(" ", states, F.min(F.when(F.col("label") == 5, F.col("src")))).alias("value"))
    lines.unionByName(header).write.text(path)
    return path


def _graph_transitions(spark, folder):
    return _chain(spark, folder).select(
        (F.col("src") + 1).cast("int").alias("q"), "label", (F.col("dst") + 1).cast("int").alias("t")
    )


def undirected_adjacency_export(spark, folder):
    edges = _orders(spark, folder)
    return layout.undirected_lines(edges, _n_nodes(edges))


def edge_list_write(spark, folder):
    path = scratch_path(spark, "edges")
    text.write_edges(_chain(spark, folder), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _colouring(spark, folder):
    edges = _chain(spark, folder)
    return swaps.colour_init(fragments.node_set(edges), _sizes(_n_nodes(edges)), seed=7).drop("slot")


def colouring_write(spark, folder):
    path = scratch_path(spark, "colours")
    text.write_numbered_lines(_colouring(spark, folder), path, "colour")
    return text.read_numbered_lines(spark, path, "colour")


def colouring_read(spark, folder):
    path = scratch_path(spark, "colours")
    text.write_colouring(_colouring(spark, folder), path)
    return text.read_colouring(spark, path)


def edges_last_write_wins(spark, folder):
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    rows = items.select(
        F.col("l_partkey").alias("src"), F.col("l_quantity").cast("int").alias("label"), F.col("l_suppkey").alias("dst"),
        "l_orderkey", "l_linenumber",
    )
    return layout.last_write_wins(rows, ["l_orderkey", "l_linenumber", "dst"])


def key_lookup_join(spark, folder):
    edges = _chain(spark, folder)
    ids = steps.label_scan(edges, [5]).select(F.col("dst").alias("node")).distinct()
    return steps.key_lookup(ids, edges, [6, 7])


# --- single steps


def frontier_labels(spark, folder):
    moves = _graph_transitions(spark, folder)
    return steps.frontier_labels(moves, steps.start_transitions(moves))


def _first(spark, folder):
    product = steps.product_edges(_chain(spark, folder), R2)
    return product, steps.product_start(product)


def next_states(spark, folder):
    product, first = _first(spark, folder)
    return steps.next_states(first, product, first)


def next_states_from_ids(spark, folder):
    product, first = _first(spark, folder)
    return steps.next_states_from_ids(first.select("node").distinct(), product, first.select("node", "q"))


def final_answers(spark, folder):
    product, first = _first(spark, folder)
    second = steps.next_states(first, product, first)
    return steps.final_answers(first.unionByName(second), R2.final)


# --- path queries


def fragment_matches(spark, folder):
    return rpq.fragment_matches(_orders(spark, folder), _years(spark, folder), ORDERS)


def compose_matches(spark, folder):
    return rpq.compose(fragment_matches(spark, folder), ORDERS)


def rpq_lookup_by_source(spark, folder):
    """From given origins over edges stored by source, of which a round reads the folders it needs."""
    key = ("by source", *graph_key(spark, folder, "handoff"))
    if key not in _stored_by_source:
        path = scratch_path(spark, "by-source")
        text.store_edges_by_source(_handoff(spark, folder), path)
        _stored_by_source[key] = path
    edges = spark.read.schema("src bigint, label int, dst bigint, folder int").parquet(_stored_by_source[key])
    return rpq.rpq(edges, R3, _start(spark), "lookup")


def rpq_partial_eval_coloured(spark, folder):
    """Fragments are the colours of a finished partitioning by boundary nodes, which leaves fewer of them than other rules."""
    fragment = _boundary_local(spark, folder).colouring.withColumnRenamed("colour", "part")
    return rpq.rpq(_orders(spark, folder), ORDERS, strategy="fragments", fragment=fragment)


def rpq_partial_eval(spark, folder):
    edges = _chain(spark, folder)
    return rpq.rpq(edges, R2, strategy="fragments", fragment=_ranges(edges))


def rpq_partial_eval_from_node(spark, folder):
    edges = _handoff(spark, folder)
    return rpq.rpq(edges, R3, _start(spark), "fragments", _ranges(edges))


# --- conjunctions and signatures


def _index(spark, folder):
    return signatures.signature_build(_handoff(spark, folder), [LEVEL])


def signature_load(spark, folder):
    path = scratch_path(spark, "signatures")
    text.write_signatures(signatures.signature_build(_chain(spark, folder)), path)
    return text.read_signatures(spark, path)


def signature_lookup(spark, folder):
    index = signatures.signature_build(_chain(spark, folder), [LEVEL])
    return signatures.block_ids(signatures.signature_lookup(index, LEVEL, [[5], [8]]), LEVEL)


def crpq_by_descent(spark, folder):
    """Sources pruned by an index stored in folders, read from the coarsest level down to single ids."""
    edges = _handoff(spark, folder)
    index = text.store_signatures(signatures.signature_build(edges), scratch_path(spark, "index"))
    return conjunctive.crpq_with_index(edges, BOTH, index, 0)


# --- fragments and partitioning


def boundary_flags(spark, folder):
    edges = _orders(spark, folder)
    packed = layout.pack_text(layout.pack(edges))
    return fragments.boundary_flags(packed, fragments.boundary_nodes(edges, _years(spark, folder)))


def adjacency_flagged(spark, folder):
    edges = _orders(spark, folder)
    return layout.pack_text(layout.pack_flagged(fragments.locality_flags(edges, _years(spark, folder))))


def relabel_edges(spark, folder):
    edges = _chain(spark, folder)
    return relabel.relabel_edges(edges, relabel.idmap_storage_order(_thirds(edges)))


_finished: dict[tuple, tuple[str, list, bool]] = {}


def _partition(name, objective, candidates):
    """A run of the whole schedule, stored like the graph itself: once in an application for each state of the table."""

    def run(spark, folder):
        key = (*graph_key(spark, folder, name), objective, candidates)
        if key not in _finished:
            edges = graph(spark, folder, name)
            n = _n_nodes(edges)
            nodes = spark.range(n).select(F.col("id").alias("node"))
            found = swaps.partition(edges, nodes, _sizes(n), objective, candidates, seed=7)
            path = scratch_path(spark, "colouring")
            text.write_colouring(found.colouring, path)
            _finished[key] = path, found.trace, found.finished
        path, trace, finished = _finished[key]
        return swaps.Partitioning(text.read_colouring(spark, path), trace, finished)

    return run


_edge_local = _partition("part_chain", "edge", "local")
_edge_random = _partition("part_chain", "edge", "random")
_boundary_local = _partition("order_follow", "boundary", "local")
_boundary_random = _partition("order_follow", "boundary", "random")


def _tally(name, objective, run):
    """Of a partitioning: nodes per colour and the score of its first colouring; whether the score of the last one, counted
    anew, is the best of the trace, and better than the first, of a run that went to its end. For swaps with neighbours
    by cross edges also the pairs whose swap would still improve it, from their gains."""

    def tally(spark, folder):
        edges, found = graph(spark, folder, name), run(spark, folder)
        part = found.colouring.withColumnRenamed("colour", "part")
        crossing = fragments.cross_edges if objective == "edge" else fragments.boundary_nodes
        scores = [row[1] if objective == "edge" else row[2] for row in found.trace]
        values = {"first_score": scores[0], "recounted": crossing(edges, part).count() == min(scores), "better": found.finished and min(scores) < scores[0]}
        if run is _edge_local:
            values["improving"] = gains.swap_gain_edge(edges, found.colouring, PARTS).where("before > after").count()
        counts = found.colouring.groupBy("colour").agg(F.count(F.lit(1)).alias("nodes"))
        kinds = {"first_score": "bigint", "improving": "bigint"}
        return counts.select("colour", "nodes", *(F.lit(v).cast(kinds.get(c, "boolean")).alias(c) for c, v in values.items()))

    return tally


def query_filter(spark, folder):
    """Query lines with a numbered start placeholder, one per order line."""
    items = spark.read.parquet(f"{folder}/lineitem.parquet")
    line = F.concat(F.lit("<<"), F.col("l_linenumber") - 1, F.lit(">> "), F.col("l_quantity").cast("int"))
    return stats.query_filter(items.select("l_orderkey", line.alias("line")), "line")


QUERIES = {
    "edge_list_load": edge_list_load,
    "edge_list_load_sld": lambda s, d: edge_list_load(s, d, "sld"),
    "layered_edges_union": layered_edges_union,
    "automaton_load": lambda s, d: text.read_transitions(s, _automaton_file(s, d), "int"),
    "start_node_load": lambda s, d: text.read_start_node(s, _automaton_file(s, d)),
    "adjacency_pack": lambda s, d: layout.pack_text(layout.pack(_chain(s, d))),
    "adjacency_unpack": lambda s, d: layout.unpack(layout.pack(_chain(s, d))),
    "adjacency_unpack_text": lambda s, d: layout.unpack_text(adjacency_flagged(s, d)),
    "sink_nodes": lambda s, d: layout.sink_nodes(_orders(s, d), _n_nodes(_orders(s, d))),
    "label_scan": lambda s, d: steps.label_scan(_chain(s, d), [5, 6, 7]),
    "label_scan_sources": lambda s, d: steps.label_scan_sources(_chain(s, d), [5, 6, 7]),
    "key_lookup_join": key_lookup_join,
    "graph_size": lambda s, d: layout.graph_size(_chain(s, d)),
    "undirected_adjacency_export": undirected_adjacency_export,
    "edge_list_write": edge_list_write,
    "colouring_write": colouring_write,
    "colouring_read": colouring_read,
    "edges_last_write_wins": edges_last_write_wins,
    "start_transitions": lambda s, d: steps.start_transitions(_graph_transitions(s, d)),
    "product_edges": lambda s, d: _first(s, d)[0],
    "product_start": lambda s, d: _first(s, d)[1],
    "frontier_labels": frontier_labels,
    "next_states": next_states,
    "next_states_from_ids": next_states_from_ids,
    "final_answers": final_answers,
    "rpq_pairs": lambda s, d: rpq.rpq(_chain(s, d), R2),
    "rpq_pairs_closure": lambda s, d: rpq.rpq(_handoff(s, d), R3),
    "rpq_pairs_lookup": lambda s, d: rpq.rpq(_chain(s, d), R2, strategy="lookup"),
    "rpq_reachable": lambda s, d: rpq.rpq_reachable(_chain(s, d), C2),
    "rpq_from_node": lambda s, d: rpq.rpq(_handoff(s, d), R3, _start(s)),
    "fragment_matches": fragment_matches,
    "compose_matches": compose_matches,
    "rpq_partial_eval": rpq_partial_eval,
    "rpq_partial_eval_from_node": rpq_partial_eval_from_node,
    "rpq_lookup_by_source": rpq_lookup_by_source,
    "rpq_partial_eval_coloured": rpq_partial_eval_coloured,
    "crpq_merge": lambda s, d: conjunctive.crpq_merge(_handoff(s, d), [R2, C2]),
    "start_label_division": lambda s, d: conjunctive.start_label_division(_handoff(s, d), [5, 8]),
    "crpq_one_go": lambda s, d: conjunctive.crpq_one_go(_handoff(s, d), BOTH),
    "crpq_support": lambda s, d: conjunctive.crpq_support(_handoff(s, d), BOTH),
    "signature_build": lambda s, d: signatures.signature_build(_chain(s, d)),
    "signature_load": signature_load,
    "signature_lookup": signature_lookup,
    "crpq_with_index": lambda s, d: conjunctive.crpq_with_index(_handoff(s, d), BOTH, _index(s, d), LEVEL),
    "crpq_by_descent": crpq_by_descent,
    "crpq_one_go_reduced": lambda s, d: conjunctive.crpq_one_go(_handoff(s, d), BOTH, reduce=True),
    "rpq_pairs_reduced": lambda s, d: rpq.rpq(_handoff(s, d), R2, strategy="reduce"),
    "fragment_assign": lambda s, d: _thirds(_chain(s, d)),
    "fragment_sizes": lambda s, d: fragments.fragment_sizes(_thirds(_chain(s, d))),
    "cross_edges": lambda s, d: fragments.cross_edges(_chain(s, d), _thirds(_chain(s, d))),
    "boundary_nodes": lambda s, d: fragments.boundary_nodes(_orders(s, d), _years(s, d)),
    "locality_flags": lambda s, d: fragments.locality_flags(_chain(s, d), _thirds(_chain(s, d))),
    "locality_flags_packed": adjacency_flagged,
    "boundary_flags": boundary_flags,
    "boundary_by_histogram": lambda s, d: fragments.boundary_by_histogram(_orders(s, d), _years(s, d)),
    "idmap_storage_order": lambda s, d: relabel.idmap_storage_order(_thirds(_chain(s, d))),
    "idmap_by_partition_file": lambda s, d: relabel.idmap_by_partition(_groups(_chain(s, d)), _thirds(_chain(s, d))),
    "idmap_by_group_size": lambda s, d: relabel.idmap_by_group_size(_turned(_chain(s, d)), _thirds(_chain(s, d))),
    "relabel_edges": relabel_edges,
    "colour_init": _colouring,
    "swap_gain_edge": lambda s, d: gains.swap_gain_edge(_chain(s, d), _colours(_chain(s, d)), PARTS),
    "swap_gain_boundary": lambda s, d: gains.swap_gain_boundary(_orders(s, d), _colours(_orders(s, d)), PARTS),
    "partition_edge_local": lambda s, d: _edge_local(s, d).colouring,
    "partition_edge_random": lambda s, d: _edge_random(s, d).colouring,
    "partition_boundary_local": lambda s, d: _boundary_local(s, d).colouring,
    "partition_boundary_random": lambda s, d: _boundary_random(s, d).colouring,
    "partition_edge_local_tally": _tally("part_chain", "edge", _edge_local),
    "partition_edge_random_tally": _tally("part_chain", "edge", _edge_random),
    "partition_boundary_local_tally": _tally("order_follow", "boundary", _boundary_local),
    "partition_boundary_random_tally": _tally("order_follow", "boundary", _boundary_random),
    "partition_trace": lambda s, d: _edge_local(s, d).trace_df(),
    "label_frequency": lambda s, d: stats.label_frequency(_chain(s, d)),
    "label_frequency_above": lambda s, d: stats.label_frequency_above(_chain(s, d), 0.02),
    "label_count": lambda s, d: stats.label_count(_chain(s, d)),
    "node_set": lambda s, d: fragments.node_set(_chain(s, d)),
    "node_count": lambda s, d: stats.node_count(_chain(s, d)),
    "query_filter": query_filter,
}
