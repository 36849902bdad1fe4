"""Times the headline queries and prints one JSON line.

``ingest`` builds the fleet tables the queries read (lockfile tree, registry,
advisories, code) and the closures; every query is then timed by itself, from
planning to the last row, and must return rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from supplygraph.plans import catalog  # noqa: E402
from supplygraph.plans.domain import Fleet  # noqa: E402
from supplygraph.session import local_session  # noqa: E402

HEADLINE = [
    "q_exact_lookup", "q_direct_dependents", "q_transitive_dependents", "q_lockfile_entries", "q_exposed_projects",
    "q_live_window", "q_shared_maintainer", "q_shared_repository", "q_shared_publisher", "q_paths_many", "q_exposure_paths",
    "q_heat", "q_import_reach", "q_code_reach", "q_reachable_routes", "closure_resolved_in", "edge_satisfied_by",
    "ver_filter_satisfying", "join_dep_resolve", "alias_components", "typosquat_edges", "agg_assess", "agg_threats",
    "agg_frontier", "agg_blast_radius", "agg_findings", "view_package_graph", "view_full_graph_stats", "win_dated_history",
    "win_publish_burst", "win_correlated_burst", "st_publish_events", "view_off_topic",
]
TABLES = [
    "entry", "lock_edge", "lock_root", "package_version", "requires", "advisory", "affects", "incident", "maintained_by",
    "published_by", "sourced_from", "function", "calls", "external_import", "calls_external", "route", "publish_event",
    "satisfied_by", "lock_closure", "resolved_in", "depends_on", "bridge", "import_reach", "heat_edges", "heat", "threat",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), app="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    started = time.perf_counter()
    fleet = Fleet.of(spark, sf_dir)
    for table in TABLES:
        t = time.perf_counter()
        getattr(fleet, table)
        print(f"  {table:20s} {time.perf_counter() - t:7.2f}s", file=sys.stderr)
    fleet.keyed("package_version", "pv")
    times["ingest"] = round(time.perf_counter() - started, 3)
    for key in HEADLINE:
        t = time.perf_counter()
        seen = Observation()
        df = catalog.QUERIES[key](spark, sf_dir)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        rows = seen.get["n"]
        times[key] = round(time.perf_counter() - t, 3)
        print(f"  {key:28s} {times[key]:7.2f}s {rows} rows", file=sys.stderr)
        if rows == 0:
            raise SystemExit(f"{key} returned no rows")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "supplygraph_headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
