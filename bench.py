"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from ebbflow.queries import QUERIES, rate_load
from ebbflow.session import build
from ebbflow.streaming.run import timings

HEADLINE = ["wc_hist", "wc_minmax", "synthetic_load", "join_then_group", "join_nway", "kmin_kmax_by_key", "group_sum", "window_count_n", "retract_sum_min_max", "cogroup_counts", "json_path", "s_join_static", "s_late_negative", "s_retract_chain", "s_synthetic_load", "s_wc_minute", "s_wc_hist", "s_extremes_retracted", "s_window_cogroup", "s_join_left_retracted"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", "bench", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{folder}/nation.parquet").count()  # the session's own start is not a query's time
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    rates = {}
    if not sys.argv[1:]:  # a live load, as fast as it comes: all events in two seconds, through random bags, delays and groups
        n = spark.read.parquet(f"{folder}/events.parquet").count()
        progress = rate_load(spark, folder, max(1, n // 2), 90)[1]
        rates = {k: round(v, 1) for k, v in (timings(progress, "came") | {"elements_per_s": timings(progress, "fed")["rows_per_s"]}).items()}
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "live_load": rates, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
