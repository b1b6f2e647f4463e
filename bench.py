"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from pathweave.functions.automaton import Automaton
from pathweave.operators import fragments, signatures
from pathweave.plans import conjunctive, rpq
from pathweave.queries import BOTH, C2, LEVEL, QUERIES, R2, R3, _index
from pathweave.sources.derived import graph

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CHAIN_OF_THREE = Automaton.of("1 5 2; 2 6 3; 3 7 4")
VARIANTS = ["boundary_local", "edge_local", "boundary_random", "edge_random"]
# Seconds after which no further partitioning is started; those left out are named in the result.
LATEST = 1200
NONDETERMINISTIC = Automaton.of("1 5 2; 2 5 2; 2 5 3; 3 6 4")


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    builder = builder.config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def chain():
        return graph(spark, FOLDER, "part_chain")

    def handoff():
        return graph(spark, FOLDER, "handoff")

    began = begin = time.time()
    rpq.rpq(handoff(), C2).count()
    warm_up = round(time.time() - begin, 2)  # JVM start-up, code generation and the edge store of one graph
    runs = {
        "load_part_chain": chain,
        "handoff_star": lambda: rpq.rpq(handoff(), R2),
        "handoff_closure": lambda: rpq.rpq(handoff(), R3),
        "chain_fixed": lambda: rpq.rpq(chain(), CHAIN_OF_THREE),
        "chain_star": lambda: rpq.rpq(chain(), R2),
        "chain_star_lookup": lambda: rpq.rpq(chain(), R2, strategy="lookup"),
        "chain_star_fragments": lambda: QUERIES["rpq_partial_eval"](spark, FOLDER),
        "chain_nondeterministic": lambda: rpq.rpq(chain(), NONDETERMINISTIC),
        "chain_closure": lambda: rpq.rpq(chain(), R3),
        "chain_reachable": lambda: rpq.rpq_reachable(chain(), C2),
        "conjunction_merge": lambda: conjunctive.crpq_merge(handoff(), [R2, C2]),
        "conjunction_one_go": lambda: conjunctive.crpq_one_go(handoff(), BOTH),
        "conjunction_index": lambda: conjunctive.crpq_with_index(handoff(), BOTH, _index(spark, FOLDER), LEVEL),
        "signature_build": lambda: signatures.signature_build(chain()),
        "boundary_nodes": lambda: fragments.boundary_nodes(chain(), fragments.fragment_assign(fragments.node_set(chain()), 3)),
        "undirected_export": lambda: QUERIES["undirected_adjacency_export"](spark, FOLDER),
        "relabel": lambda: QUERIES["relabel_edges"](spark, FOLDER),
        "swap_gain_edge": lambda: QUERIES["swap_gain_edge"](spark, FOLDER),
        "swap_gain_boundary": lambda: QUERIES["swap_gain_boundary"](spark, FOLDER),
    }
    runs |= {f"partition_{v}": lambda v=v: QUERIES[f"partition_{v}"](spark, FOLDER) for v in VARIANTS}
    seconds, rows, errors, skipped = {}, {}, {}, []
    for name, run in runs.items():
        if name.startswith("partition_") and time.time() - began > LATEST:
            skipped.append(name)
            continue
        begin = time.time()
        try:
            rows[name] = run().count()
            seconds[name] = round(time.time() - begin, 2)
        except Exception as error:  # the others still count
            errors[name] = f"{type(error).__name__}: {str(error)[:300]}"
    total = round(sum(seconds.values()), 2)
    result = {"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "rows": rows, "warm_up": warm_up, "sf": os.path.basename(FOLDER.rstrip("/"))}
    print(json.dumps(result | ({"errors": errors} if errors else {}) | ({"not_started": skipped} if skipped else {})))


if __name__ == "__main__":
    main()
