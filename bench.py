"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

import json
import os
import statistics
import tempfile
import time

from tsengine.plans import catalogue
from tsengine.session import get_spark

NAMES = ("fetch_group_daily", "ar_features", "interp_both", "hierarchy_rollup", "mapped_fetch", "feature_stats", "range_stats", "peak_match", "metrics_monthly", "backtest_metrics", "nearest_cell", "calendar_features")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in NAMES:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "sum of query medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
