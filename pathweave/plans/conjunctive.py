"""Conjunctions of path queries over the same pair of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.automaton import START, Automaton
from pathweave.operators.signatures import in_blocks, signature_descent
from pathweave.operators.steps import label_scan, product_edges
from pathweave.plans.fixpoint import fixpoint
from pathweave.plans.middle import group_of, middle
from pathweave.plans.rpq import Answers, Ending, ProductGraph, answers, started_from
from pathweave.session import settle, small

STATE = ["origin", "node", "q", "lastq"]


def crpq_merge(edges: DataFrame, automata: list[Automaton]) -> DataFrame:
    """Pairs that answer every query. Each query starts only from origins that the ones before have left."""
    counted = [(_start_edges(edges, a), i) for i, a in enumerate(automata)]
    found = None
    for _, i in sorted(counted):  # the one with the fewest first edges prunes most for the least
        pairs = answers(edges, automata[i], None if found is None else found.origin_set())
        found = pairs if found is None else found.also(pairs)
        kept, seen = settle(found.found)
        found = Answers(kept, found.origins, found.ends)
        if not seen["rows"] and (found.origins is None or found.origins.isEmpty() or found.ends.isEmpty()):
            break
    return found.table()


def _start_edges(edges: DataFrame, automaton: Automaton) -> int:
    return label_scan(edges, automaton.labels_from({START})).count()


def start_label_division(edges: DataFrame, labels: list) -> DataFrame:
    """Sources with an edge of **every** label."""
    found = label_scan(edges, labels).select("src", "label").groupBy("src").agg(F.count_distinct("label").alias("_n"))
    return found.where(F.col("_n") == len(set(labels))).select("src")


def start_branch_division(edges: DataFrame, automaton: Automaton) -> DataFrame:
    """Sources with an edge of some start label of **every branch**."""
    groups = automaton.start_label_groups()
    has = [F.bool_or(F.col("label").isin(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    found = label_scan(edges, sorted({x for g in groups for x in g})).groupBy("src").agg(*has)
    for i in range(len(groups)):
        found = found.where(F.col(f"g{i}"))
    return found.select("src")


def crpq_support(
    edges: DataFrame, automaton: Automaton, index: DataFrame | None = None, level: int | None = None, reduce: bool = False
) -> DataFrame:
    """Qualifying pairs with the states before their last edges, ``(origin, node, lastq)``.

    The automaton has one branch per conjunct; branches share only the start and the final state, and each ends in a
    state of its own, so a pair qualifies when as many last states occur as there are. Sources are pruned first, by
    their start labels or, with ``index``, by the blocks of ``level`` whose signature allows all branches, found from the
    coarsest level down. ``reduce`` leaves out moves from which the final state isn't reached.
    """
    automaton.branches  # raises for an automaton this method does not decide; use crpq_merge then
    automaton = automaton.trimmed
    groups = automaton.start_label_groups()
    moves = product_edges(edges, automaton)
    if reduce:
        moves = Ending(edges, automaton).moves(moves)
    # a state in the middle of a branch, where one answers so many pairs that they aren't followed one by one
    between = middle(moves.where(F.col("q") != START), automaton, automaton.branches)
    if between is not None:
        moves = between.moves(moves)
    product = ProductGraph(moves)
    begins = product.moves.where(F.col("q") == START)
    if index is None:
        begins = started_from(begins, start_branch_division(edges, automaton).withColumnRenamed("src", "node"), "src")
    else:
        begins = in_blocks(begins, signature_descent(index, level, groups), level)
    seed = begins.select(
        F.col("src").alias("origin"), F.col("dst").alias("node"), F.col("t").alias("q"), F.col("q").alias("lastq")
    )

    keys = STATE
    if between is not None:
        keys = [*STATE, "through"]
        seed, origins = between.seeds(seed)

    def expand(frontier: DataFrame, rows: int, tags: frozenset) -> DataFrame:
        # nothing leaves the final state, and where a state came from does not matter before the final one
        left = frontier.where(F.col("q") != automaton.final).drop("lastq")
        moved = product.step(left, rows)
        if between is not None:
            moved = moved.where(~(F.col("through") & F.col("after")))
        return moved.select("origin", F.col("dst").alias("node"), F.col("t").alias("q"), _last(automaton, "q", "t"), *keys[len(STATE):])

    seed = seed.withColumn("lastq", F.when(F.col("q") == automaton.final, F.col("lastq")).otherwise(F.lit(0)))
    visited = fixpoint(
        product.spark,
        seed,
        expand,
        keys,
        product.parts,
        automaton.successors({START}),
        automaton.successors,
        product.keyed.relay,
    )
    found = visited.table(frozenset({automaton.final}))
    if found is None:
        found = product.spark.createDataFrame([], "origin bigint, node bigint, q int, lastq int")
    ends = found.where(F.col("q") == automaton.final).select("origin", "node", "lastq")
    if between is not None:
        return _through(ends, origins, between.ends(automaton.final), automaton, between.found)
    complete = ends.groupBy("origin", "node").agg(F.count(F.lit(1)).alias("_n"))
    complete = complete.where(F.col("_n") == len(automaton.last_states)).select("origin", "node")
    return ends.join(complete, ["origin", "node"], "left_semi")


def _through(ends: DataFrame, origins: DataFrame, after: DataFrame, automaton: Automaton, found: set[int]) -> DataFrame:
    """Qualifying pairs of ``crpq_support`` where branches ``found`` have a middle: a pair has the last state of such a branch
    also if its origin, in ``origins`` ``(origin, group)``, and its node, in ``after`` ``(node, group)``, have the branch."""
    branches = automaton.branches
    of_last = {q: branches[q] for q in automaton.last_states}
    every = sum(1 << g for g in of_last.values())

    def bits(rows: DataFrame, group, *by: str) -> DataFrame:
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), group)
        return rows.dropna(subset=list(by)).groupBy(*by).agg(F.bit_or(bit).alias(f"{by[-1]}_has" if len(by) == 1 else "has"))

    pairs, _ = settle(bits(ends, group_of(of_last, "lastq"), "origin", "node"))
    origins, n_origins = settle(bits(origins, F.col("group"), "origin"))
    after, n_after = settle(bits(after, F.col("group"), "node"))
    had = pairs.join(small(origins, n_origins), "origin", "left").join(small(after, n_after), "node", "left")
    both = F.coalesce(F.col("origin_has").bitwiseAND(F.col("node_has")), F.lit(0).cast("bigint"))
    complete = had.where(F.col("has").bitwiseOR(both) == every).select("origin", "node")
    if found == set(of_last.values()):
        # pairs that no round found: every branch has a middle that answers them
        all_of = Answers(pairs.select("origin", "node").limit(0), origins.where(F.col("origin_has") == every).select("origin"),
                         after.where(F.col("node_has") == every).select("node"))
        complete = complete.unionByName(all_of.table().join(pairs, ["origin", "node"], "left_anti"))
    lasts = F.array(*(F.lit(q).cast("int") for q in automaton.last_states))
    return complete.withColumn("lastq", F.explode(lasts))


def _last(automaton: Automaton, left: str, reached: str):
    return F.when(F.col(reached) == automaton.final, F.col(left)).otherwise(F.lit(0)).alias("lastq")


def crpq_one_go(edges: DataFrame, automaton: Automaton, reduce: bool = False) -> DataFrame:
    """The pairs of ``crpq_support``."""
    return crpq_support(edges, automaton, reduce=reduce).select("origin", "node").distinct()


def crpq_with_index(edges: DataFrame, automaton: Automaton, index: DataFrame, level: int) -> DataFrame:
    """As ``crpq_one_go``, with sources pruned by a signature index. Blocks may admit too much, never too little."""
    return crpq_support(edges, automaton, index, level).select("origin", "node").distinct()
