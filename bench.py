"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

#: The plan engine's whole queries and its heavier operators. Each is run once to warm up, then RUNS times.
HEADLINE = ("q1_json", "q3_json", "q5_json", "q6_json", "topn", "sort_full", "join_multi_key", "join_full", "union", "agg_bucketed", "agg_nunique", "agg_median", "agg_nth_element", "events_by_user", "bin_pmod", "un_sin")
RUNS = 3


def main() -> None:
    from pyspark.sql import SparkSession

    from planweft.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "spark": spark.version, "cpus": int(cpus), "shuffle_partitions": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
