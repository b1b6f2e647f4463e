import re

import pytest

import pathweave.functions.keyed as keyed
import pathweave.plans.fixpoint as loop
import pathweave.plans.rpq as plans
import pathweave.session as session
from pathweave.functions.automaton import Automaton
from pathweave.operators.fragments import fragment_assign, fragment_ranges, node_set
from pathweave.plans.rpq import compose, fragment_matches, rpq, rpq_reachable
from pathweave.sources.text import store_edges_by_source
from tests.conftest import accepted, random_edges, rows

R2 = Automaton.of("1 5 2; 2 6 2; 2 7 3")
R3 = Automaton.of("1 5 2; 1 6 2; 2 5 2; 2 6 2")
R4 = Automaton.of("1 5 2; 2 5 2; 2 5 3; 3 6 4")
LOOP = Automaton.of("1 5 2; 2 6 1; 2 7 3; 3 5 3; 3 8 1", final=3)


@pytest.mark.parametrize("automaton", [R2, R4, LOOP])
def test_all_strategies_equal_plain_search(spark, edges_of, automaton):
    data = random_edges(1)
    edges, want = edges_of(data), accepted(data, automaton)
    assert want
    assert rows(rpq(edges, automaton)) == want
    assert rows(rpq(edges, automaton, strategy="lookup")) == want
    assert rows(rpq(edges, automaton, strategy="reduce")) == want
    ranges = fragment_ranges(node_set(edges), 30, 144)
    assert rows(rpq(edges, automaton, strategy="fragments", fragment=ranges)) == want
    assert rows(rpq_reachable(edges, automaton)) == {(node,) for _, node in want}


@pytest.mark.parametrize("strategy", ["join", "lookup", "fragments", "reduce"])
def test_given_starts(spark, edges_of, strategy):
    data = random_edges(2)
    origins = {0, 13, 27, 40, 999}
    starts = spark.createDataFrame([(o,) for o in origins], "node bigint")
    edges = edges_of(data)
    part = fragment_assign(node_set(edges), 3)
    assert rows(rpq(edges, R3, starts, strategy, part)) == accepted(data, R3, origins)


def test_many_starts_are_looked_up_by_salted_join(spark, edges_of, monkeypatch):
    data = random_edges(2) + [(0, 5, n) for n in range(200, 240)]
    origins = {0, 13, 27, 40, 999}
    starts = spark.createDataFrame([(o,) for o in origins], "node bigint")
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 2)
    assert rows(rpq(edges_of(data), R3, starts)) == accepted(data, R3, origins)


def test_a_start_with_many_edges_is_spread(spark, edges_of):
    found = plans.started_from(edges_of([(7, 5, n) for n in range(4000)]).repartition(8), spark.createDataFrame([(7,)], "node bigint"), "src")
    assert found.rdd.getNumPartitions() == 8 and found.count() == 4000


def test_moves_that_end_nowhere_are_left_out(spark, edges_of):
    """A long dead end and one that only leaves a cycle: neither is stored for the rounds forwards."""
    data = [(0, 5, 1), (1, 7, 2), (3, 5, 4)] + [(n, 6, n + 1) for n in range(4, 12)] + [(20, 6, 21), (21, 6, 20), (3, 5, 20)]
    edges = edges_of(data)
    ending = plans.Ending(edges, R2)
    assert rows(ending.states) == {(2, 3), (1, 2)}
    assert rows(ending.moves(plans.product_edges(edges, R2))) == {(0, 1, 1, 2), (1, 2, 2, 3)}
    assert rows(rpq(edges, R2, strategy="reduce")) == {(0, 2)}
    # a transition from the start to the final state, and an answer to none
    direct = Automaton.of("1 5 3; 1 6 2; 2 7 3")
    assert rows(rpq(edges, direct, strategy="reduce")) == accepted(data, direct)
    assert rows(rpq(edges, Automaton.of("1 5 2; 2 9 3"), strategy="reduce")) == set()


def test_nondeterministic_automaton_across_fragments(edges_of):
    data = [(0, 5, 3), (3, 5, 6), (6, 6, 9)]
    edges = edges_of(data)
    part = fragment_assign(node_set(edges), 3)
    assert rows(rpq(edges, R4)) == {(0, 9)}
    assert rows(compose(fragment_matches(edges, part, R4), R4)) == {(0, 9)}


def test_cycle_ends(edges_of):
    a = Automaton.of("1 5 2; 2 5 2")
    assert rows(rpq(edges_of([(1, 5, 2), (2, 5, 1)]), a)) == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_empty_word_does_not_match(edges_of):
    assert rows(rpq(edges_of([(1, 5, 2)]), Automaton(((1, 5, 1),), 1))) == {(1, 2)}


@pytest.mark.parametrize("strategy", ["join", "lookup", "fragments"])
def test_absent_label_gives_no_rows_but_the_schema(edges_of, strategy):
    edges = edges_of([(1, 4, 2), (2, 4, 3)])
    out = rpq(edges, R2, strategy=strategy, fragment=fragment_assign(node_set(edges), 2))
    assert out.columns == ["origin", "node"] and out.count() == 0


def test_automaton_without_a_way_to_the_final_state(edges_of):
    assert rpq(edges_of([(1, 5, 2)]), Automaton.of("1 5 2; 3 6 4")).count() == 0


def test_string_labels(spark):
    lines = """1 id 2; 2 324 3; 3 category 4; 3 relate 6; 4 Music 5; 6 video 7; 7 id 8; 8 428 9; 9 category 10; 9 comments 12;
    9 relate 14; 10 Entertainment 11; 12 39 13; 14 video 15; 15 id 16; 16 278 17; 17 relate 20; 17 relate 21;
    17 category 18; 18 Entertainment 19; 20 video 7; 21 video 22; 22 id 23; 23 573 24; 24 category 25; 25 Entertainment 26"""
    data = [(int(s), label, int(d)) for s, label, d in (line.split() for line in lines.split(";"))]
    edges = spark.createDataFrame(data, "src bigint, label string, dst bigint")
    assert rows(rpq(edges, Automaton.of("1 relate 2; 2 video 3"))) == {(3, 7), (9, 15), (17, 7), (17, 22)}
    assert rows(rpq(edges, Automaton.of("1 category 2; 2 Entertainment 3"))) == {(9, 11), (17, 19), (24, 26)}


def test_too_many_rounds_is_an_error_and_settings_come_back(spark, edges_of):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    chain = edges_of([(i, 5, i + 1) for i in range(6)])
    a = Automaton.of("1 5 2; 2 5 2")
    with pytest.raises(RuntimeError):
        rpq(chain, a, max_rounds=3)
    assert rpq(chain, a, max_rounds=6).count() == 21
    assert before == (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions"))


def _hub():
    """Half of all edges enter node 0 or leave it."""
    data = [(i, 5, 0) for i in range(1, 60)] + [(0, 6, i) for i in range(60, 120)] + [(0, 7, i) for i in range(1, 30)]
    return data + [(i, 6, i + 1) for i in range(60, 110)] + [(i, 7, 0) for i in range(80, 120)] + [(0, 6, 0)]


@pytest.mark.parametrize("automaton", [R2, R3])
def test_hot_keys_on_both_sides_of_the_join(monkeypatch, edges_of, automaton):
    monkeypatch.setattr(keyed, "HOT_ROWS", 4)
    monkeypatch.setattr(session, "EDGES_PER_PART", 20)
    data = _hub()
    product = plans.ProductGraph(plans.product_edges(edges_of(data), automaton.trimmed))
    assert product.keyed.hot is not None
    assert rows(rpq(edges_of(data), automaton)) == accepted(data, automaton)


def test_states_outgrow_their_partitions(monkeypatch, edges_of):
    monkeypatch.setattr(loop, "STATES_PER_PART", 900)
    monkeypatch.setattr(loop, "MAX_RUNS", 2)
    data = _hub()
    assert rows(rpq(edges_of(data), R3)) == accepted(data, R3)


def test_lookup_with_a_frontier_too_large_to_broadcast(monkeypatch, edges_of):
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 3)
    data = random_edges(3)
    assert rows(rpq(edges_of(data), R3, strategy="lookup")) == accepted(data, R3)


def test_round_moves_neither_edges_nor_visited_states(edges_of):
    """The plan of a later round: two exchanges, of frontier and candidates, and no sort of a stored side."""
    plans_seen = []
    original = loop.settle

    def spy(df):
        plans_seen.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df)

    data = [(i, 5, i + 1) for i in range(8)]
    try:
        loop.settle = spy
        rpq(edges_of(data), Automaton.of("1 5 2; 2 5 2"))
    finally:
        loop.settle = original
    late = plans_seen[4]
    assert late.count("Exchange hashpartitioning") == 2
    assert late.count("LeftAnti") >= 3
    assert late.count("Sort [") == 2


def test_a_lookup_reads_the_folders_of_its_frontier(spark, edges_of, tmp_path, monkeypatch):
    data = random_edges(4, graphs=40)
    stored = store_edges_by_source(edges_of(data), str(tmp_path / "e"))
    assert rows(stored.select("src", "label", "dst")) == set(data)
    assert rows(rpq(stored, R3, strategy="lookup")) == accepted(data, R3)
    origins = {next(s for s, lab, d in data if lab == 5 and any(x[0] == d and x[1] == 6 for x in data))}
    read, original = [], plans.in_folders

    def spy(edges, seen):
        out = original(edges, seen)
        read.append(len(out.inputFiles()) if not seen else out.select("folder").distinct().count())
        return out

    monkeypatch.setattr(plans, "in_folders", spy)
    starts = spark.createDataFrame([(o,) for o in origins], "node bigint")
    assert rows(rpq(stored, R3, starts, "lookup")) == accepted(data, R3, origins)
    assert read and read[0] == 1 and max(read) <= 12 < stored.select("folder").distinct().count() / 4
    # other folders are ruled out before any file is opened
    one = original(stored, {f"folders_{i}": int(i == 0) for i in range(4)})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"folder#\d+ = 0\)\], PushedFilters: \[\]", plan)  # a filter of partitions


def test_a_large_frontier_is_still_looked_up(spark, monkeypatch, edges_of, tmp_path):
    monkeypatch.setattr(plans, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(keyed, "HOT_ROWS", 4)
    data = _hub()
    stored = store_edges_by_source(edges_of(data), str(tmp_path / "e"))
    monkeypatch.setattr(plans, "ProductGraph", None)  # the stored join is not what was asked for
    assert rows(rpq(stored, R3, strategy="lookup")) == accepted(data, R3)
    assert rows(rpq(edges_of(data), R2, strategy="lookup")) == accepted(data, R2)


def test_rounds_store_no_start_moves(monkeypatch, edges_of):
    kept, original = [], plans.ProductGraph

    def spy(moves):
        product = original(moves)
        kept.append({r["q"] for r in product.moves.select("q").distinct().collect()})
        return product

    monkeypatch.setattr(plans, "ProductGraph", spy)
    data = random_edges(1)
    assert rows(rpq(edges_of(data), R3)) == accepted(data, R3)
    assert rows(rpq(edges_of(data), LOOP)) == accepted(data, LOOP)
    assert kept == [{2}, {1, 2, 3}]


def test_composing_does_not_probe_dead_states(monkeypatch, edges_of):
    data = random_edges(1)
    edges, probed, original = edges_of(data), [], plans.ProductGraph.step
    matches = fragment_matches(edges, fragment_assign(node_set(edges), 3), R2)

    def spy(self, frontier, rows):
        probed.append({r["q"] for r in frontier.select("q").distinct().collect()})
        return original(self, frontier, rows)

    monkeypatch.setattr(plans.ProductGraph, "step", spy)
    assert rows(compose(matches, R2)) == accepted(data, R2)
    assert probed and all(3 not in states for states in probed)


def test_rounds_leave_no_files_but_the_states(spark, edges_of, monkeypatch):
    """Runs merged into others and the moves of a query that has ended are deleted, whatever the number of rounds."""
    gone, runs = [], []
    for where in (loop, plans):
        monkeypatch.setattr(where, "discard", lambda t: gone.append(t) or session.discard(t))
    original = loop.Visited.add
    monkeypatch.setattr(loop.Visited, "add", lambda self, run, *args: runs.append((self, run)) or original(self, run, *args))
    edges = edges_of([(i, 5, i + 1) for i in range(14)])
    found = rpq(edges, Automaton.of("1 5 2; 2 5 2"), spark.createDataFrame([(0,)], "node bigint"))
    assert rows(found) == {(0, i) for i in range(1, 15)}
    held = [run for run, _, _ in runs[0][0].runs]
    assert len(gone) > 3 and not any(t is h for t in gone for h in held)
    files = lambda t: t._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    exists = lambda t: (p := spark._jvm.org.apache.hadoop.fs.Path(files(t))).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    assert not any(map(exists, gone)) and all(map(exists, held))
