"""Regular path queries: pairs ``(origin, node)`` joined by a path whose labels the automaton accepts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.automaton import START, Automaton
from pathweave.functions.keyed import Keyed, hot_keys
from pathweave.operators.fragments import boundary_nodes
from pathweave.operators.steps import label_scan, product_edges, product_start
from pathweave.plans.fixpoint import Visited, fixpoint
from pathweave.plans.middle import middle
from pathweave.session import BROADCAST_ROWS, discard, loop_settings, parts_for, settle, small
from pathweave.sources.text import folders_of, in_folders

PAIR_STATE = ["origin", "node", "q"]
# Parts into which the rows of one origin are cut when many starts are looked up.
SALTS = 16
# Pairs that one task makes from origins and nodes that all go together.
PAIRS_PER_PART = 50_000_000


class ProductGraph:
    """Moves ``(src, q) -> (dst, t)`` stored once, partitioned by the state they leave, for a whole query."""

    def __init__(self, moves: DataFrame):
        self.spark: SparkSession = moves.sparkSession
        flat = moves.persist()
        rows = flat.count()
        self.parts = parts_for(self.spark, rows)
        with loop_settings(self.spark, self.parts):
            self.keyed = Keyed(flat, ["src", "q"], ["dst", "t"], rows, self.parts)
        flat.unpersist()

    @property
    def moves(self) -> DataFrame:
        return self.keyed.table

    def drop(self) -> None:
        """Delete the stored moves; no round comes any more."""
        discard(self.keyed.table)

    def step(self, frontier: DataFrame, rows: int) -> DataFrame:
        """All moves from the frontier: its columns with ``node`` as ``src``, and ``dst``, ``t``."""
        return self.keyed.join(frontier.withColumnRenamed("node", "src"), rows)


@dataclass
class Answers:
    """Pairs ``(origin, node)`` that rounds found, ``found``, and those of every ``origins`` with every ``ends`` (one column
    each, ``None`` if there are none of this kind). No pair is in both."""

    found: DataFrame
    origins: DataFrame | None = None
    ends: DataFrame | None = None

    def table(self) -> DataFrame:
        if self.origins is None:
            return self.found
        origins, many = settle(self.origins)
        ends, seen = settle(self.ends)
        if not many["rows"] or not seen["rows"]:
            return self.found
        # as many rows as answers, which are made where they are read and move nowhere
        parts = max(origins.sparkSession.sparkContext.defaultParallelism, -(-many["rows"] * seen["rows"] // PAIRS_PER_PART))
        origins = origins.repartition(min(parts, many["rows"]), "origin")
        return self.found.unionByName(origins.crossJoin(small(ends, seen)))

    def origin_set(self) -> DataFrame:
        """Origins ``(node)`` of any pair."""
        own = self.found.select(F.col("origin").alias("node"))
        return (own if self.origins is None else own.unionByName(self.origins.select(F.col("origin").alias("node")))).distinct()

    def also(self, other: "Answers") -> "Answers":
        """The pairs in both; those with a null end are in none."""
        found = self.found.join(other.found, ["origin", "node"], "left_semi")
        for pairs, by in ((self.found, other), (other.found, self)):
            if by.origins is not None:
                found = found.unionByName(pairs.join(by.origins, "origin", "left_semi").join(by.ends, "node", "left_semi").select("origin", "node"))
        if self.origins is None or other.origins is None:
            return Answers(found)
        return Answers(found, self.origins.join(other.origins, "origin", "left_semi"), self.ends.join(other.ends, "node", "left_semi"))


class Ending:
    """States ``(node, q)`` from which the final state is reached, found backwards from the ends of the last edges. These
    rounds carry no origins, so they move at most one row a state however many pairs there are, and what is then
    stored for the rounds forwards has no move that answers nothing."""

    def __init__(self, edges: DataFrame, automaton: Automaton):
        moves = product_edges(edges, automaton.inner)
        back = ProductGraph(moves.select(F.col("dst").alias("src"), F.col("t").alias("q"), F.col("src").alias("dst"), F.col("q").alias("t")))
        ends = product_edges(edges, automaton.ending).select(F.col("dst").alias("node"), F.col("t").alias("q"))
        turned = automaton.inner.reversed
        visited = fixpoint(
            back.spark,
            ends,
            lambda frontier, rows, tags: _pairs(back.step(_leaving(frontier, turned, tags), 0)),
            ["node", "q"],
            back.parts,
            frozenset({automaton.final}),
            turned.successors,
            back.keyed.relay,
        )
        back.drop()
        self.rows = visited.rows
        found = visited.table()
        self.states = ends.limit(0) if found is None else found

    def moves(self, moves: DataFrame) -> DataFrame:
        """Those of ``moves`` that lead to such a state."""
        keys = self.states.select(F.col("node").alias("dst"), F.col("q").alias("t"))
        return moves.join(small(keys, self.rows), ["dst", "t"], "left_semi").select(*moves.columns)


def rpq(
    edges: DataFrame,
    automaton: Automaton,
    starts: DataFrame | None = None,
    strategy: str = "join",
    fragment: DataFrame | None = None,
    max_rounds: int | None = None,
) -> DataFrame:
    """All pairs, or those whose origin is in ``starts`` (column ``node``).

    ``strategy``: ``"join"`` stores the edges the automaton can use once and probes them each round; ``"lookup"``
    reads from ``edges``, a stored table, only what each round's frontier and labels need; ``"fragments"`` evaluates
    inside the fragments of ``fragment`` first and then composes; ``"reduce"`` is ``"join"`` over the moves alone from
    which the final state is reached, which pays where most paths end nowhere.
    """
    automaton = automaton.trimmed
    if strategy == "fragments":
        matches = fragment_matches(edges, fragment, automaton, starts)
        return compose(matches, automaton, starts, max_rounds)
    if strategy == "lookup":
        return _answers(edges.sparkSession, _lookup(edges, automaton, starts, max_rounds), automaton.final)
    return answers(edges, automaton, starts, strategy == "reduce", max_rounds, through=starts is None and max_rounds is None).table()


def answers(
    edges: DataFrame,
    automaton: Automaton,
    starts: DataFrame | None = None,
    reduce: bool = False,
    max_rounds: int | None = None,
    through: bool = True,
) -> Answers:
    """The pairs of :func:`rpq` by rounds over stored moves. With ``through``, where moves are dense enough for one state to
    answer many pairs, those aren't followed one by one (see :mod:`pathweave.plans.middle`)."""
    automaton = automaton.trimmed
    # the first edges are read from the table: what is stored for the rounds has only moves that rounds can make
    inner, beginning = product_edges(edges, automaton.inner), product_edges(edges, automaton.beginning)
    if reduce:
        ending = Ending(edges, automaton)
        inner, beginning = ending.moves(inner), ending.moves(beginning)
    seed = product_start(beginning)
    if starts is not None:
        seed = started_from(seed, starts, "origin")
    between = middle(inner, automaton, dict.fromkeys(range(1, automaton.n_states + 1), 0)) if through else None
    if between is None:
        product, keys = ProductGraph(inner), PAIR_STATE
    else:
        product, keys = ProductGraph(between.moves(inner)), [*PAIR_STATE, "through"]
        seed, origins = between.seeds(seed)

    def expand(frontier: DataFrame, rows: int, tags: frozenset) -> DataFrame:
        moved = product.step(_leaving(frontier, automaton, tags), rows)
        if between is None:
            return _pairs(moved, "origin")
        return _pairs(moved.where(~(F.col("through") & F.col("after"))), "origin", "through")

    visited = fixpoint(
        product.spark,
        seed,
        expand,
        keys,
        product.parts,
        automaton.successors({START}),
        automaton.successors,
        product.keyed.relay,
        max_rounds,
    )
    product.drop()
    found = _answers(product.spark, visited, automaton.final)
    if between is None:
        return Answers(found)
    return Answers(found, origins.select("origin"), between.ends(automaton.final).select("node"))


def rpq_reachable(edges: DataFrame, automaton: Automaton, max_rounds: int | None = None) -> DataFrame:
    """Nodes at the end of an accepting path from anywhere."""
    automaton = automaton.trimmed
    product = ProductGraph(product_edges(edges, automaton.inner))
    seed = product_start(product_edges(edges, automaton.beginning)).select("node", "q")
    visited = fixpoint(
        product.spark,
        seed,
        lambda frontier, rows, tags: _pairs(product.step(_leaving(frontier, automaton, tags), 0)),
        ["node", "q"],
        product.parts,
        automaton.successors({START}),
        automaton.successors,
        product.keyed.relay,
        max_rounds,
    )
    product.drop()
    return _answers(product.spark, visited, automaton.final, ["node"])


def fragment_matches(
    edges: DataFrame, fragment: DataFrame, automaton: Automaton, starts: DataFrame | None = None
) -> DataFrame:
    """Partial answers ``(q_from, q_to, u, v)`` found without passing through another fragment.

    Paths begin at a boundary node with any transition, or anywhere with a start transition, and are extended until
    they reach a boundary node; an edge that leaves its fragment always does. Kept are those that stopped there or are
    in the final state. All transitions of a state and label are followed.
    """
    moves = product_edges(edges, automaton)
    boundary = boundary_nodes(edges, fragment).withColumn("hit", F.lit(True))
    for end in ("src", "dst"):
        flag = boundary.select(F.col("node").alias(end), F.col("hit").alias(f"{end}_stop"))
        moves = moves.join(flag, end, "left").withColumn(f"{end}_stop", F.coalesce(f"{end}_stop", F.lit(False)))
    product = ProductGraph(moves)
    begins = product.moves.where((F.col("q") == START) | F.col("src_stop"))
    if starts is not None:
        from_start = started_from(begins, starts, "src")
        begins = begins.where("src_stop").unionByName(from_start.where(~F.col("src_stop")))
    seed = begins.select(
        F.col("q").alias("q_from"), F.col("src").alias("u"), F.col("dst").alias("node"), F.col("t").alias("q"),
        F.col("dst_stop").alias("stop"),
    )

    def extend(frontier: DataFrame, rows: int, tags: frozenset) -> DataFrame:
        inside = _leaving(frontier, automaton, tags).where(~F.col("stop"))
        further = product.step(inside.drop("stop"), rows)
        return further.select(
            "q_from", "u", F.col("dst").alias("node"), F.col("t").alias("q"), F.col("dst_stop").alias("stop")
        )

    visited = fixpoint(
        product.spark,
        seed,
        extend,
        ["q_from", "u", "node", "q", "stop"],
        product.parts,
        frozenset(t for _, _, t in automaton.transitions),
        automaton.successors,
        product.keyed.relay,
    )
    product.drop()
    found = visited.table()
    if found is None:
        return product.spark.createDataFrame([], "q_from int, q_to int, u bigint, v bigint")
    kept = found.where(F.col("stop") | (F.col("q") == automaton.final))
    return kept.select("q_from", F.col("q").alias("q_to"), "u", F.col("node").alias("v"))


def compose(
    matches: DataFrame, automaton: Automaton, starts: DataFrame | None = None, max_rounds: int | None = None
) -> DataFrame:
    """Chain partial answers on (state, node) from the start state; pairs that end in the final state.

    A partial answer is a way through the automaton, so states follow each other as the automaton's do, any number of
    transitions at once: rounds look only at runs of states that theirs can be among, and states that nothing leaves
    are not probed.
    """
    automaton = automaton.trimmed
    product = ProductGraph(
        matches.select(
            F.col("u").alias("src"), F.col("q_from").alias("q"), F.col("v").alias("dst"), F.col("q_to").alias("t")
        )
    )
    seed = product_start(product.moves)
    if starts is not None:
        seed = started_from(seed, starts, "origin")
    visited = fixpoint(
        product.spark,
        seed,
        lambda frontier, rows, tags: _pairs(product.step(_leaving(frontier, automaton, tags), rows), "origin"),
        PAIR_STATE,
        product.parts,
        automaton.reaches({START}),
        automaton.reaches,
        product.keyed.relay,
        max_rounds,
    )
    product.drop()
    return _answers(product.spark, visited, automaton.final)


def _lookup(edges: DataFrame, automaton: Automaton, starts: DataFrame | None, max_rounds: int | None) -> Visited:
    """Rounds that read ``edges``: of a table stored by source (``store_edges_by_source``) only the folders in which sources
    of the frontier lie, and of any table only the round's labels. The frontier is broadcast while it is small; beyond
    that both sides are dealt out by source, hubs and crowded sources cut."""
    spark = edges.sparkSession
    steps = small(automaton.to_df(spark), len(automaton.transitions))
    first = label_scan(edges, automaton.labels_from({START}))
    if starts is not None:
        keys, seen = settle(starts.select("node").distinct(), **folders_of("node", edges))
        first = started_from(in_folders(first, seen), keys, "src")
    seed = product_start(first.join(steps.where(F.col("q") == START), "label").select("src", "q", "dst", "t"))
    seed, seen = settle(seed)
    parts = parts_for(spark, seen["rows"])
    hubs: list = []

    def probe(frontier: DataFrame, rows: int, tags: frozenset) -> DataFrame:
        # tells folders of a table that has any from the frontier's sources, in one small job
        folders = folders_of("node", edges)
        held = frontier.agg(*(c.alias(n) for n, c in folders.items())).first().asDict() if folders else {}
        read = in_folders(label_scan(edges, automaton.labels_from(tags)), held).select("src", "label", "dst")
        moves = read.join(steps, "label").select("src", "q", "dst", "t")
        left = _leaving(frontier, automaton, tags).withColumnRenamed("node", "src")
        if rows <= BROADCAST_ROWS:
            # the broadcast is of the frontier as counted; transitions multiply it afterwards
            return _pairs(moves.join(F.broadcast(left), ["src", "q"]), "origin")
        if not hubs:
            every = product_edges(edges, automaton)
            hubs.append((hot_keys(every, ["src", "q"], edges.count(), parts, "_shares"),))
        return _pairs(Keyed(moves, ["src", "q"], ["dst", "t"], 0, parts, lay=False, hot=hubs[0][0]).join(left, rows), "origin")

    return fixpoint(
        spark,
        seed,
        probe,
        PAIR_STATE,
        parts,
        automaton.successors({START}),
        automaton.successors,
        max_rounds=max_rounds,
    )


def started_from(rows: DataFrame, starts: DataFrame, column: str) -> DataFrame:
    """``rows`` whose ``column`` is one of ``starts``: by broadcast where the starts, counted, are few, so that the rows of
    one origin stay spread as they are; else by a join whose start side is repeated over salts and whose rows are dealt
    out by origin and salt, so that a hub isn't one task."""
    keys, seen = settle(starts.select(F.col("node").alias(column)).distinct())
    if seen["rows"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), column, "left_semi")
    salted = keys.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", salt).join(salted, [column, "_salt"], "left_semi").drop("_salt")


def _leaving(frontier: DataFrame, automaton: Automaton, tags: frozenset) -> DataFrame:
    """Frontier rows in a state that some transition leaves."""
    alive = {q for q, _, _ in automaton.transitions} & tags
    return frontier if alive == tags else frontier.where(F.col("q").isin(sorted(alive)))


def _pairs(moved: DataFrame, *carried: str) -> DataFrame:
    """The states reached by moves: the end node and state replace those left."""
    return moved.select(*carried, F.col("dst").alias("node"), F.col("t").alias("q"))


def _answers(spark: SparkSession, visited: Visited, final: int, columns=("origin", "node")) -> DataFrame:
    return _final(spark, visited.table(frozenset({final})), final, list(columns))


def _final(spark: SparkSession, states: DataFrame | None, final: int, columns: list[str]) -> DataFrame:
    """States are distinct already, so one state's rows are distinct answers."""
    if states is None:
        return spark.createDataFrame([], ", ".join(f"{c} bigint" for c in columns))
    return states.where(F.col("q") == final).select(*columns)
