"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once timed (full materialisation through a
no-op sink, so nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from srcatlas.plans import registry  # noqa: E402
from srcatlas.session import drop_tables, local_session  # noqa: E402

HEADLINE = ["selected_files", "chunks", "chunk_counts", "vector_search", "resolved_imports", "graph_edges",
            "degrees", "top_edges", "sample_chunks", "architecture_context", "cycle_nodes", "cycles", "node_view"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="srcatlas-bench")
    qs = registry.queries()
    times = {}
    for name in names:
        run(qs[name](spark, sf_dir))             # warm-up
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
        drop_tables(spark)                       # what the query wrote on its way
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
