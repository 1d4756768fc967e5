"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan runs to a ``noop`` sink (nothing is collected to the
driver) and is timed separately.  Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "filter_combined", "search_text", "preview_page", "facets_all", "facet_list", "stats_counts", "stats_distinct",
    "stats_quartiles", "stats_histogram", "stats_top", "prediction_matrix", "junk_columns",
    "junk_duplicates", "tile_heatmap_all", "tile_box", "tile_density", "tile_flows", "tile_map", "tile_timeline",
    "timeline_sublanes", "tile_sequence", "seq_mermaid", "ts_trend", "closest_match", "fold_events",
    "activity_counts", "adhoc_query", "snapshot_manifest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from tablescope.session import local_session
    cores = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cores=cpus, shuffle_partitions=max(8, 2 * cores), app="tablescope-bench")
    from tablescope.plans import queries
    qs = queries()
    names = only or HEADLINE
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    # warm-up: JVM start-up and JIT are not query costs -- a generic scan and
    # aggregate (not one of the benchmark queries)
    from pyspark.sql import functions as F
    for _ in range(2):
        (spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority")
         .agg(F.count(F.lit(1)), F.approx_count_distinct("o_custkey"), F.avg("o_totalprice"))
         .write.format("noop").mode("overwrite").save())
    # Python worker start-up likewise (a trivial Arrow batch pass)
    spark.range(1000).mapInPandas(lambda it: (b for b in it), "id long").write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        try:
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 -- report, keep benchmarking
            errors[name] = str(e).splitlines()[0][:200]
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
