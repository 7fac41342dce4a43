"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

The trace store is projected and written once, as a user would hold it; each
query then reads that store and is run to the end, once to warm up and once
timed. The sum holds the writing, which makes relations that the queries read.
``$BENCH_DIR`` is the folder for it, a shared one on a cluster; a temporary one
else. Prints one line of JSON.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "session_counts cost_distribution session_shapes agent_types co_occurrence command_failures error_signatures tool_failures "
    "path_failures missing_file_recovery idle_gaps context_reloads reload_cost_split slash_commands skill_activity weekly_trend "
    "enrichment_coverage select_runs select_sessions view_sessions view_project_rollups session_digest view_session_header"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    folder = os.environ.get("BENCH_DIR") or tempfile.mkdtemp(prefix="tracewell-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tracewell.plans import ask
    from tracewell.plans.registered import bindings, open_store
    from tracewell.storage import StoredStore, write_store

    began = time.perf_counter()
    write_store(open_store(spark, sf_dir), f"{folder}/store")
    times = {"write_store": round(time.perf_counter() - began, 3)}
    store = StoredStore.read(spark, f"{folder}/store")
    for name in HEADLINE:
        given = bindings(name, store)
        for _ in range(2):
            began = time.perf_counter()
            ask(store, name, **given).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - began, 3)
    line = {"metric": "writing the store, and headline queries on it, warm, in all", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
