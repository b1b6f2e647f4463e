import pytest

from pathweave.functions.automaton import Automaton
from pathweave.operators import signatures
from pathweave.operators.signatures import block_ids, signature_build, signature_descent, signature_lookup
from pathweave.plans.conjunctive import (
    crpq_merge,
    crpq_one_go,
    crpq_support,
    crpq_with_index,
    start_branch_division,
    start_label_division,
)
from pathweave.sources.text import store_signatures
from tests.conftest import accepted, random_edges, rows

# joint automaton, its conjuncts
CASES = [
    ("1 5 2; 2 6 2; 2 7 4; 1 6 3; 3 5 3; 3 8 4", ["1 5 2; 2 6 2; 2 7 3", "1 6 2; 2 5 2; 2 8 3"]),
    # alternatives at the start of a branch and two transitions into the final state from one state
    ("1 5 2; 1 6 2; 2 7 4; 2 8 4; 1 7 3; 3 5 3; 3 6 4", ["1 5 2; 1 6 2; 2 7 3; 2 8 3", "1 7 2; 2 5 2; 2 6 3"]),
    ("1 5 2; 2 6 3; 3 5 2; 3 7 4", ["1 5 2; 2 6 3; 3 5 2; 3 7 4"]),
]


@pytest.mark.parametrize("joint, parts", CASES)
def test_methods_agree(edges_of, joint, parts):
    data = random_edges(5, nodes=7, edges=30)
    edges, automata = edges_of(data), [Automaton.of(p) for p in parts]
    want = set.intersection(*(accepted(data, a) for a in automata))
    assert want
    together = Automaton.of(joint)
    assert rows(crpq_merge(edges, automata)) == want
    assert rows(crpq_one_go(edges, together)) == want
    assert rows(crpq_one_go(edges, together, reduce=True)) == want
    index = signature_build(edges)
    for level in (0, 2):
        assert rows(crpq_with_index(edges, together, index, level)) == want


def test_descent_equals_lookup(edges_of, tmp_path):
    data = [(s * 97, lab, t) for s, lab, t in random_edges(8, graphs=40)]
    index = signature_build(edges_of(data), list(range(0, 16))).persist()
    stored = store_signatures(index, str(tmp_path / "index"))
    for groups, level in (([[5], [6]], 0), ([[5, 6], [7], [8]], 3), ([[5], [6]], 12), ([[5], [9]], 0)):
        want = {(b,) for b in {s >> level for s, _, _ in data} if all({lab for s, lab, _ in data if s >> level == b} & set(g) for g in groups)}
        assert rows(signature_descent(stored, level, groups)) == want
    assert rows(signature_descent(index, 3, [[5, 6], [7], [8]], 4)) == rows(signature_lookup(index, 3, [[5, 6], [7], [8]]))
    assert rows(signature_descent(index.where("level in (2, 9)"), 4, [[5]])) == rows(signature_lookup(index, 4, [[5]]))
    with pytest.raises(ValueError):
        signature_descent(index.where("level > 4"), 3, [[5]])


def test_descent_reads_below_kept_blocks_only(edges_of, tmp_path, monkeypatch):
    """Label 5 everywhere, label 6 in two subtrees: of 64, two are read at level 0."""
    data = [(n * 512 + i, 5, 0) for n in range(128) for i in range(4)] + [(700, 6, 0), (60_000, 6, 0), (513, 6, 0)]
    stored = store_signatures(signature_build(edges_of(data), list(range(0, 17))), str(tmp_path / "index"))
    read, original = [], signatures.in_folders

    def spy(table, seen):
        read.append(original(table, seen).where("level = 0").count())
        return original(table, seen)

    monkeypatch.setattr(signatures, "in_folders", spy)
    assert rows(signature_descent(stored, 0, [[5], [6]])) == {(513,)}
    assert read and max(read) <= 40 < stored.where("level = 0").count() / 10


def test_an_index_without_the_level(edges_of):
    data = random_edges(5, nodes=7, edges=30)
    edges, (joint, parts) = edges_of(data), CASES[0]
    want = set.intersection(*(accepted(data, Automaton.of(p)) for p in parts))
    index = signature_build(edges, [1, 2])
    assert rows(crpq_with_index(edges, Automaton.of(joint), index, 4)) == want  # from level 2
    assert rows(signature_lookup(index, 4, [[5], [6]])) == rows(signature_lookup(signature_build(edges, [4]), 4, [[5], [6]]))
    with pytest.raises(ValueError):
        crpq_with_index(edges, Automaton.of(joint), index, 0)


def test_large_blocks_are_written_out_in_steps(spark):
    blocks = spark.createDataFrame([(3,), (0,)], "block bigint")
    assert {r[0] for r in rows(block_ids(blocks, 12))} == set(range(4096)) | set(range(3 * 4096, 4 * 4096))
    assert rows(block_ids(blocks, 0)) == {(3,), (0,)}


def test_shared_predecessor_counts_once(edges_of):
    edges = edges_of([(1, 5, 2), (2, 6, 3), (2, 7, 3)])
    a = Automaton.of("1 5 2; 2 6 3; 2 7 3")
    assert rows(crpq_support(edges, a)) == {(1, 3, 2)}


def test_automaton_that_one_go_cannot_decide_is_refused(edges_of):
    with pytest.raises(ValueError):
        crpq_one_go(edges_of([(1, 5, 2)]), Automaton.of("1 5 2; 2 6 4; 1 7 3"))


def test_start_divisions(edges_of):
    edges = edges_of([(1, 5, 2), (1, 6, 2), (1, 6, 3), (2, 5, 1), (3, 6, 1), (3, 7, 1)])
    assert rows(start_label_division(edges, [5, 6])) == {(1,)}
    a = Automaton.of("1 5 2; 1 7 2; 2 6 4; 1 6 3; 3 6 4")
    assert rows(start_branch_division(edges, a)) == {(1,), (3,)}


def test_signatures(edges_of):
    data = random_edges(6)
    edges = edges_of(data)
    nodes = {e[0] for e in data} | {e[2] for e in data}
    levels = len(bin(len(nodes))) - 2
    index = signature_build(edges)
    got = rows(index)
    assert got == {(k, s >> k, label) for s, label, _ in data for k in range(levels)}
    # a parent's signature is the union of its children's
    assert {(k - 1, b, x) for k, b, x in got if k > 0} == {(k, b >> 1, x) for k, b, x in got if k < levels - 1}
    found = signature_lookup(index, 2, [[5], [6]])
    blocks = {b for k, b, x in got if k == 2 and x == 5} & {b for k, b, x in got if k == 2 and x == 6}
    assert rows(found) == {(b,) for b in blocks}
    assert rows(block_ids(found, 2)) == {(n,) for b in blocks for n in range(b * 4, b * 4 + 4)}


def test_signature_levels_are_made_in_place(spark, edges_of, monkeypatch):
    data = random_edges(12, graphs=60)
    want = {(k, s >> k, lab) for s, lab, _ in data for k in (0, 1, 3, 5, 9)}
    edges = edges_of(data)
    assert rows(signature_build(edges, [0, 1, 3, 5, 9])) == want
    plan = signature_build(edges, [0, 1, 3, 5, 9])._jdf.queryExecution().executedPlan().toString()
    # distinct sources and labels, and once more by blocks; no level moves rows
    assert plan.count("Exchange hashpartitioning") == 2
    monkeypatch.setattr(signatures, "STEP_BITS", 2)
    assert rows(signature_build(edges, [0, 1, 3, 5, 9])) == want
