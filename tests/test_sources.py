import random
import re

import pytest

import pathweave.functions.keyed as keyed
import pathweave.sources.derived as derived
from pathweave.functions.automaton import Automaton
from pathweave.functions.rank import global_rank
from pathweave.operators import layout, relabel
from pathweave.operators.fragments import (
    boundary_by_histogram,
    boundary_nodes,
    fragment_assign,
    locality_flags,
    node_set,
)
from pathweave.operators.gains import neighbours
from pathweave.operators.signatures import signature_build
from pathweave.operators.stats import label_frequency
from pathweave.operators.steps import label_scan_sources
from pathweave.sources import text
from pathweave.sources.derived import successor
from tests.conftest import random_edges, rows


def test_edge_files_in_both_orders(spark, edges_of, tmp_path):
    data = random_edges(10, graphs=2)
    for order in ("sdl", "sld"):
        path = str(tmp_path / order)
        text.write_edges(edges_of(data), path, order)
        assert rows(text.read_edges(spark, path, order, "int")) == set(data)


def test_layers(spark, tmp_path):
    (tmp_path / "1.csv").write_text("1,2,0.5\n2,3,0.1\n1,2,0.7\n")
    (tmp_path / "2.csv").write_text("3,1\n")
    found = text.read_layers(spark, {1: str(tmp_path / "1.csv"), 2: str(tmp_path / "2.csv")})
    assert rows(found) == {(0, 1, 1), (1, 1, 2), (2, 2, 0)}


def test_automaton_file(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("1 2 5\n2 2 6\n4 17\n2 3 7\n")
    a = text.read_automaton(spark, str(path))
    assert a == Automaton(((1, 5, 2), (2, 6, 2), (2, 7, 3)), 4) and a.final == 4
    assert rows(text.read_start_node(spark, str(path))) == {(17,)}
    (tmp_path / "b.txt").write_text("1 2 5\n")
    with pytest.raises(ValueError):
        text.read_automaton(spark, str(tmp_path / "b.txt"))


def test_numbered_lines(spark, tmp_path):
    table = spark.createDataFrame([(i, i * 7 % 3) for i in range(500)], "node bigint, colour int")
    path = str(tmp_path / "c")
    text.write_numbered_lines(table.repartition(5), path, "colour")
    assert rows(text.read_numbered_lines(spark, path, "colour")) == {(i, i * 7 % 3) for i in range(500)}


def test_signature_files(spark, edges_of, tmp_path):
    built = signature_build(edges_of(random_edges(11)))
    path = str(tmp_path / "s")
    text.write_signatures(built, path)
    assert rows(text.read_signatures(spark, path)) == rows(built)
    assert {r[0] for r in rows(text.read_signatures(spark, path, 3))} == {3}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "13.txt").write_text("0 1,2\n1 3\n")
    assert rows(text.read_signatures(spark, str(tmp_path / "t"))) == {(13, 0, 1), (13, 0, 2), (13, 1, 3)}


def test_pack_and_text_forms(edges_of):
    data = random_edges(12, graphs=3)
    edges = edges_of(data)
    packed = layout.pack(edges)
    assert rows(layout.unpack(packed)) == set(data)
    assert rows(layout.unpack_text(layout.pack_text(packed))) == set(data)
    flagged = layout.pack_text(layout.pack_flagged(locality_flags(edges, fragment_assign(node_set(edges), 3))))
    assert rows(layout.unpack_text(flagged)) == set(data)
    for row in flagged.collect():
        assert row["dsts"] == ":".join(
            f"{d}-{int(d % 3 == row['src'] % 3)}" for d in sorted(d for s, x, d in data if (s, x) == (row["src"], row["label"]))
        )


def test_long_lists_take_several_rows(edges_of):
    data = [(0, 5, d) for d in range(40)] + [(1, 5, 2), (0, 6, 1)]
    packed = layout.pack(edges_of(data), longest=10)
    found = packed.collect()
    assert sorted((r["piece"], r["dsts"]) for r in found if (r["src"], r["label"]) == (0, 5)) == [(i, list(range(10 * i, 10 * i + 10))) for i in range(4)]
    assert {r["piece"] for r in found if (r["src"], r["label"]) != (0, 5)} == {0}
    assert rows(layout.unpack(packed)) == set(data) and sum(len(r["dsts"]) for r in found) == len(data)


def test_undirected_lines_keep_gaps_and_multiplicity(spark, edges_of, tmp_path):
    edges, path = edges_of([(0, 5, 2), (0, 6, 2), (2, 5, 4), (4, 5, 0)]), str(tmp_path / "lines")
    layout.write_undirected_lines(edges, 6, path)
    def lines(at):  # a blank ends every piece that is written
        return {n: line.rstrip() for n, line in rows(text.read_lines(spark, at))}

    assert lines(path) == {0: "3 3 5", 1: "", 2: "1 1 5", 3: "", 4: "1 3", 5: ""}
    pieces = rows(layout.undirected_lines(edges, 6, longest=2))
    assert {p for p in pieces if p[0] == 1} == {(1, 0, "3 3"), (1, 1, "5")}
    layout.write_undirected_lines(edges, 6, path + "2", longest=2)  # hubs are written from several pieces
    assert lines(path + "2") == lines(path)


def test_label_predicate_reaches_the_edge_store(spark, edges_of, tmp_path):
    stored = text.store_edges(edges_of(random_edges(15, graphs=2)), str(tmp_path / "store"))
    plan = label_scan_sources(stored, [5, 6])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(label, [5,6])]" in plan
    assert "ReadSchema: struct<src:bigint,label:int>" in plan


def test_boundary_definitions_agree(edges_of):
    edges = edges_of(random_edges(13))
    part = fragment_assign(node_set(edges), 3)
    assert rows(boundary_nodes(edges, part)) == rows(boundary_by_histogram(edges, part)) != set()


def test_ends_outside_all_fragments_are_kept(spark, edges_of):
    edges = edges_of([(0, 5, 1), (1, 5, 9), (8, 5, 0), (8, 5, 9)])
    part = spark.createDataFrame([(0, 0), (1, 0)], "node bigint, part int")
    assert rows(locality_flags(edges, part)) == {(0, 5, 1, True), (1, 5, 9, False), (8, 5, 0, False), (8, 5, 9, False)}
    assert rows(boundary_nodes(edges, part)) == rows(boundary_by_histogram(edges, part)) == {(9,), (0,)}


def test_groups_of_one_size_all_find_partners(spark):
    old = spark.createDataFrame([(n, p) for p, own in enumerate(([0, 1], [2, 3], [4])) for n in own], "node bigint, part int")
    new = spark.createDataFrame([(n, p) for p, own in enumerate(([10], [11, 12], [13, 14], [15, 16, 17])) for n in own], "node bigint, part int")
    assert rows(relabel.idmap_by_group_size(old, new)) == {(0, 11), (1, 12), (2, 13), (3, 14), (4, 10)}


def test_lines_of_many_splits_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "l")
    (tmp_path / "l").mkdir()
    for i in range(7):
        (tmp_path / "l" / f"part-{i}").write_text("".join(f"{i}-{j}\n" for j in range(i * 40)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        got = rows(text.read_lines(spark, path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == set(enumerate(f"{i}-{j}" for i in range(7) for j in range(i * 40)))


def test_global_rank(spark):
    values = spark.range(1000).selectExpr("id * 7919 % 1009 as v").repartition(7)
    got = rows(global_rank(values, ["v"], "at"))
    assert got == {(v, i) for i, v in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))}


def test_successor_stays_inside_its_key(spark):
    table = spark.createDataFrame([(0, 3), (0, 1), (1, 2), (0, 2), (2, 9)], "k int, v int")
    assert rows(successor(table, ["k"], ["v"], "v").select("k", "v", "next")) == {(0, 1, 2), (0, 2, 3)}


def test_relabelling(spark, edges_of):
    idmap = spark.createDataFrame([(1, 11), (2, 12)], "old_id bigint, new_id bigint")
    assert rows(relabel.relabel_edges(edges_of([(1, 5, 2), (2, 5, 7)]), idmap)) == {(11, 5, 12), (12, 5, 7)}
    with pytest.raises(Exception, match="without a new id: 3"):
        relabel.relabel_edges(edges_of([(3, 5, 1)]), idmap).collect()


def test_idmaps_are_one_to_one(spark):
    nodes = spark.range(60).withColumnRenamed("id", "node")
    storage = nodes.selectExpr("node", "cast(case when node < 10 then 2 when node < 30 then 0 else 1 end as int) as part")
    groups = nodes.selectExpr("node", "cast(case when node % 6 = 0 then 7 when node % 6 < 3 then 8 else 9 end as int) as part")
    place = dict(rows(storage))
    group = dict(rows(groups))
    ordered = rows(relabel.idmap_storage_order(storage))
    assert len({o for o, _ in ordered}) == len({n for _, n in ordered}) == 60
    by_size = rows(relabel.idmap_by_partition(groups, storage))
    equal = rows(relabel.idmap_by_group_size(groups, storage))
    # sizes 10, 20, 30 on both sides: group 7 meets part 2, 8 meets 0, 9 meets 1
    assert by_size == equal
    assert {(group[o], place[n]) for o, n in equal} == {(7, 2), (8, 0), (9, 1)}


def test_label_frequency_adds_up(edges_of):
    found = label_frequency(edges_of(random_edges(14))).collect()
    shares = [r["share"] for r in found]
    assert shares == sorted(shares) and abs(sum(shares) - 1) < 1e-9


def _successors(table):
    """By plain search: rows of a known key, each with the value of the next one."""
    found = []
    for k in {r[0] for r in table if r[0] is not None}:
        mine = sorted(r for r in table if r[0] == k)
        found += [(k, a[1], b[2]) for a, b in zip(mine, mine[1:])]
    return sorted(found, key=str)


def _initial_plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def test_successor_moves_rows_of_plain_keys_once(spark, monkeypatch):
    table = [(k, v, None if v == 3 else 10 * v) for k in range(6) for v in range(k + 2)] + [(None, 1, 1), (None, 2, 2)]
    table += [(9, v, v) for v in range(40)]
    df = spark.createDataFrame(table, "k int, v int, w int")
    monkeypatch.setattr(derived, "global_rank", lambda *_: pytest.fail("a global order of keys that fit a partition"))
    plain = successor(df, ["k"], ["v"], "w").select("k", "v", "next")
    assert sorted(map(tuple, plain.collect()), key=str) == _successors(table)
    plan = _initial_plan(plain)
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("steps", [1, 2])
def test_successor_of_a_hot_key(spark, monkeypatch, steps):
    monkeypatch.setattr(keyed, "HOT_ROWS", 5)
    used = []
    monkeypatch.setattr(derived, "_by_position", lambda df, *rest, run=derived._by_position: used.append(df.count()) or run(df, *rest))
    table = [(k, v) for k in range(30) for v in range(3)] + [(77, v) for v in range(100)] + [(None, v) for v in range(50)]
    found = successor(spark.createDataFrame(table, "k int, v int"), ["k"], ["v"], "v", steps).select("k", "v", "next")
    want = [(k, v, v + steps) for k, v in table if k is not None and v + steps < (100 if k == 77 else 3)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert used == [100]


def test_stored_edges_are_dealt_out_once(spark, tmp_path):
    data = [(s, 5 + s % 2, d) for s in range(20) for d in range(5)]
    edges = spark.createDataFrame(data + data, "src bigint, label int, dst bigint")
    assert sorted(map(tuple, text.store_edges(edges, str(tmp_path / "e")).collect())) == sorted(data)
    assert "hashpartitioning" not in _initial_plan(text.by_label(edges))


def test_signatures_hold_no_table_of_blocks(spark, edges_of):
    rng = random.Random(5)
    data = [(rng.choice([rng.randrange(40), rng.randrange(5000), 2**21 + rng.randrange(9)]), rng.randrange(4), 1) for _ in range(400)]
    levels = [0, 1, 3, 9, 10, 11, 20, 21]
    index = signature_build(edges_of(data + [(7, 2, 9), (7, 2, 8)]), levels)
    want = sorted({(k, s >> k, lab) for s, lab, _ in [*data, (7, 2, 9)] for k in levels})
    assert sorted(map(tuple, index.collect())) == want
    # the one distinct is that of sources and labels, in two steps, for each branch of the plan
    plan = signature_build(edges_of(data), [0, 3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2


def test_neighbours_are_counted_in_one_exchange(spark, edges_of):
    data = random_edges(3, graphs=3) + [(1, 5, 2), (2, 5, 1), (1, 6, 2), (1, 5, 1)]
    found = neighbours(edges_of(data))
    assert "Exchange hashpartitioning" in (plan := found._jdf.queryExecution().executedPlan().toString())
    assert plan.count("Exchange hashpartitioning") == 1
    data = set(data)
    m = lambda p, q: sum((s, d) == (p, q) for s, _, d in data)
    want = {(p, q, m(p, q) + m(q, p), m(q, p)) for s, _, d in data if s != d for p, q in ((s, d), (d, s))}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_words_are_those_between_blanks_of_any_kind(spark, tmp_path):
    """A line is split once, whatever is asked of its words."""
    lines = ["1 2 5", "  3 4 6  ", "1  2   7", "1\t2 8", "\t1 2 3", "1 2\t", "1 2 9\t", "1 \x0b2\f5", "", " ", "7", "7 17", "1 2 3 4", "a b c", "1\u00a02 3 4", "x  y"]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    plain = [re.split(r"[ \t\x0b\f]+", line.strip(" ")) for line in lines]
    table = text._words(spark, str(tmp_path))
    assert sorted(list(r["w"]) for r in table.collect()) == sorted(w for w in plain if w[0])
    plan = text.read_transitions(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
