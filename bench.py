"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose tables and cores.

Each query runs once to warm up and then five times into a sink that discards rows; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from basalt import registry
from basalt.session import build_session

HEADLINE = (
    "dashboard_two_key", "count_star", "count_filtered", "agg_filtered", "group_by_one", "group_by_two", "count_distinct", "group_by_date", "top_groups", "filter_and_str_last",
    "project_arith", "topk_offset", "topk_per_group", "join_inner_auto", "join_chain", "join_semi", "join_theta", "point_lookup", "range_lookup", "lsm_latest_version",
    "window_rank", "window_running_total", "asof_join", "bitmap_or_count", "event_windows", "column_profile",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    known, times = registry.queries(), {}
    for name in HEADLINE:
        seconds = []
        for _ in range(6):
            began = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - began)
        times[name] = round(statistics.median(seconds[1:]), 4)
    spark.stop()
    sf = folder.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    sys.exit(main())
