"""Regular path queries, signature pruning and balanced partitioning of edge-labelled graphs, as Spark jobs."""
