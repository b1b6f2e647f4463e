import pytest

from pathweave.functions.automaton import Automaton
from pathweave.plans import conjunctive, rpq
from pathweave.plans.middle import _reached, middle
from pathweave.operators.steps import product_edges
from tests.conftest import accepted, random_edges, rows

CLOSURE = Automaton.of("1 5 2; 1 6 2; 2 5 2; 2 6 2")
STAR = Automaton.of("1 8 2; 2 9 2; 2 10 2; 2 11 3")
OTHER = Automaton.of("1 5 2; 2 6 2; 2 6 3; 3 7 2; 2 7 4")
PLAIN = Automaton.of("1 5 2; 2 6 2; 2 7 3")
BOTH = Automaton.of("1 5 2; 2 6 2; 2 7 4; 1 8 3; 3 9 3; 3 10 3; 3 11 4")


def spied(monkeypatch, module):
    """What ``middle`` gives in ``module``, and rows of states that its rounds hold."""
    middles, held = [], []
    look, loop = module.middle, rpq.fixpoint

    def spy(*args):
        middles.append(look(*args))
        return middles[-1]

    def count(*args, **named):
        visited = loop(*args, **named)
        held.append(visited.rows)
        return visited

    monkeypatch.setattr(module, "middle", spy)
    monkeypatch.setattr(module, "fixpoint", count)
    return middles, held


@pytest.mark.parametrize("automaton, labels", [(CLOSURE, (5, 6, 7)), (STAR, (8, 9, 10, 11)), (OTHER, (5, 6, 6, 7))])
def test_pairs_equal_plain_search(spark, edges_of, monkeypatch, automaton, labels):
    middles, _ = spied(monkeypatch, rpq)
    # one dense graph, sparse ones beside it, and chains into and out of the dense one
    data = random_edges(3, graphs=1, nodes=30, edges=120, labels=labels) + random_edges(4, graphs=12, nodes=8, edges=12, labels=labels)
    data += [(s + 1000, lab, d + 1000) for s, lab, d in random_edges(5, graphs=8, nodes=8, edges=14, labels=labels)]
    data += [(n, lab, n + 1 if n < 2006 else 3) for n in range(2000, 2007) for lab in labels]
    data += [(4 if n == 3000 else n, lab, n + 1) for n in range(3000, 3007) for lab in labels]
    found = rpq.rpq(edges_of(data), automaton)
    assert middles[-1] is not None
    assert rows(found) == accepted(data, automaton)
    assert found.count() == len(accepted(data, automaton))


def test_closure_holds_no_row_a_pair(edges_of, monkeypatch):
    """300 origins into a dense middle and 300 nodes out of it: 90,000 pairs, which rounds don't carry."""
    _, held = spied(monkeypatch, rpq)
    ring = [(a, 5, b) for a in range(20) for b in ((a + 1) % 20, (a + 7) % 20)]
    data = ring + [(100 + i, 5, i % 20) for i in range(300)] + [(i % 20, 6, 1000 + i) for i in range(300)]
    assert rpq.rpq(edges_of(data), CLOSURE).count() == 320 * 320
    assert sum(held) < 2000


def _conjunction():
    """Two dense middles, for both branches or one, entered by the same origins and left to the same nodes."""
    data = [(a, lab, b) for a in range(10) for lab in (6, 9) for b in ((a + 1) % 10, (a + 3) % 10)]
    data += [(100 + i, lab, i % 10) for i in range(60) for lab in ((5, 8) if i % 3 else (5,))]
    data += [(i % 10, lab, 1000 + i) for i in range(60) for lab in ((7, 11) if i % 4 else (11,))]
    # found by rounds alone, and by both
    data += [(100, 5, 2000), (2000, 7, 1004), (100, 8, 3000), (3000, 11, 1004), (4000, 5, 4001), (4001, 6, 4002), (4002, 7, 4003), (4000, 8, 4003), (4003, 11, 4003)]
    return data


@pytest.mark.parametrize("data", [_conjunction(), [e for e in _conjunction() if e[1] != 6], random_edges(6, graphs=3, nodes=20, edges=160, labels=(5, 6, 7, 8, 9, 10, 11))])
def test_conjunctions_equal_plain_search(edges_of, monkeypatch, data):
    middles, held = spied(monkeypatch, conjunctive)
    want = accepted(data, PLAIN) & accepted(data, STAR)
    edges = edges_of(data)
    assert rows(conjunctive.crpq_one_go(edges, BOTH)) == want
    assert middles[-1] is not None
    support = conjunctive.crpq_support(edges, BOTH, reduce=True)
    assert rows(support) == {(a, b, q) for a, b in want for q in (2, 3)}
    assert support.count() == 2 * len(want)
    merged = conjunctive.crpq_merge(edges, [PLAIN, STAR])
    assert rows(merged) == want and merged.count() == len(want)


def test_conjunction_holds_no_row_a_pair(edges_of, monkeypatch):
    _, held = spied(monkeypatch, conjunctive)
    data = [(a, 9, b) for a in range(10) for b in ((a + 1) % 10, (a + 3) % 10)]
    data += [(100 + i, 8, i % 10) for i in range(300)] + [(i % 10, 11, 1000 + i) for i in range(300)]
    data += [(100 + i, 5, 5000 + i) for i in range(300)] + [(5000 + i, 7, 1000 + i) for i in range(300)]
    assert rows(conjunctive.crpq_one_go(edges_of(data), BOTH)) == {(100 + i, 1000 + i) for i in range(300)}
    assert sum(held) < 2000


def test_chains_take_no_rounds(spark, edges_of):
    """A state is reached through chains, from beside a ring that nothing enters."""
    data = [(i, 5, i + 1) for i in range(200)] + [(200, 6, 0), (50, 6, 120), (300, 5, 301), (301, 5, 300), (301, 6, 302)]
    moves = product_edges(edges_of(data), CLOSURE).where("q = 2")
    roots = spark.createDataFrame([(0, 10, 2, 0)], "root int, node bigint, q int, group int")
    assert rows(_reached(moves, roots, CLOSURE)) == {(0, n, 2) for n in range(201)}


def test_sparse_moves_have_no_middle(edges_of):
    moves = product_edges(edges_of([(i, 5, i + 1) for i in range(20)]), CLOSURE).where("q = 2")
    assert middle(moves, CLOSURE, {2: 0}) is None


def test_null_ends(edges_of):
    """A null is an end like any other, and nothing goes on from it."""
    data = [(a, 5, b) for a in range(10) for b in ((a + 1) % 10, (a + 3) % 10)]
    edges = edges_of(data + [(11, 5, 0), (2, 6, 12)])
    edges = edges.unionByName(edges.sparkSession.createDataFrame([(None, 5, 3), (4, 5, None)], edges.schema))
    found = rpq.rpq(edges, CLOSURE)
    assert rows(found) == {(a, b) for a in (*range(10), 11, None) for b in (*range(10), 12, None)}
    assert found.count() == 12 * 12
