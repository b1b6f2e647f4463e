import random

import pytest
from pyspark.sql import SparkSession

EDGES = "src bigint, label int, dst bigint"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def edges_of(spark):
    return lambda rows: spark.createDataFrame(sorted(set(rows)), EDGES)


def random_edges(seed, graphs=12, nodes=12, edges=22, labels=(5, 6, 7, 8)):
    """Many small random graphs side by side, so that one query covers all of them."""
    rng = random.Random(seed)
    rows = set()
    for g in range(graphs):
        ids = range(g * nodes, (g + 1) * nodes)
        for _ in range(edges):
            rows.add((rng.choice(ids), rng.choice(labels), rng.choice(ids)))
    return sorted(rows)


def accepted(edges, automaton, origins=None):
    """Pairs by plain search from every node."""
    moves = {}
    for src, label, dst in edges:
        for q, lab, t in automaton.transitions:
            if lab == label:
                moves.setdefault((src, q), set()).add((dst, t))
    found = set()
    for origin in {e[0] for e in edges} if origins is None else origins:
        seen, todo = set(), list(moves.get((origin, 1), ()))
        while todo:
            state = todo.pop()
            if state not in seen:
                seen.add(state)
                todo.extend(moves.get(state, ()))
        found |= {(origin, node) for node, q in seen if q == automaton.final}
    return found


def rows(df):
    return {tuple(r) for r in df.collect()}
