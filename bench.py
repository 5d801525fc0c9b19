"""

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and forces full evaluation with the ``noop`` sink.
The derived tables are loaded once (timed as ``load_tables_sec``); each
headline query then runs twice, cold and warm.  ``value`` = load + warm sum.
Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    ("j1_j3_projection", ["j1_graph_edges", "j3_graph_nodes"]),
    ("p2_paths_limit6", ["p2_shortest_path_limited"]),
    ("p3_paths_bidirectional", ["p3_shortest_path_bidirectional"]),
    ("n1_neighborhood_depth2", ["n1_neighborhood_nodes", "n1_neighborhood_edges"]),
    ("m9_refresh_graph", ["m9_refresh_graph_edges", "m9_refresh_graph_nodes"]),
    ("a8_export_edges", ["a8_export_edges"]),
    ("s2_similar_top10", ["s2_similar_topk"]),
    ("s7_similar_approx", ["s7_similar_approx"]),
    ("a5_read_snapshot", ["a5_read_graph_snapshot"]),
    ("k1_pagerank", ["k1_pagerank"]),
    ("a3_extract_links", ["a3_extract_links"]),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from linkweave.plans import catalog
    from linkweave.sources import tables as TB
    from linkweave.session import get_spark

    spark = get_spark(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    queries = catalog.QUERIES
    # Warm-up: JVM and Python workers only (not timed).  It touches no graph
    # table, so the first timed query pays for deriving pages/links.
    catalog.QUERIES["s6_embedding_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    # Load: derive and store the page/link/update tables once (the reference's
    # "database load"); every query after this scans them.
    t0 = time.perf_counter()
    TB.fx_pages(spark, sf_dir)
    TB.fx_links(spark, sf_dir)
    TB.fx_page_updates(spark, sf_dir)
    load = round(time.perf_counter() - t0, 3)

    # Each headline query runs twice: the first (cold) run pays JVM code
    # generation for its plan shapes; the second (warm) is the steady state.
    cold: dict[str, float] = {}
    times: dict[str, float] = {}
    for label, names in HEADLINE:
        if not all(n in queries for n in names):
            continue
        for rep in range(2):
            t0 = time.perf_counter()
            for n in names:
                queries[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            (cold if rep == 0 else times)[label] = round(time.perf_counter() - t0, 3)

    # Per-question throughput of the path batch.
    n_pairs = TB.fx_path_queries(spark, sf_dir).count()
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total_warm_plus_load",
        "value": round(load + sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "load_tables_sec": load,
        "cold_queries": cold,
        "cold_total": round(load + sum(cold.values()), 3),
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
        "path_pairs": n_pairs,
        "p2_ms_per_pair": round(1000 * times.get("p2_paths_limit6", 0) / max(n_pairs, 1), 3),
        "p3_ms_per_pair": round(1000 * times.get("p3_paths_bidirectional", 0) / max(n_pairs, 1), 3),
    }
    spark.stop()
    print(json.dumps(out))


if __name__ == "__main__":
    main()
