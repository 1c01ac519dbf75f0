"""Time the headline queries; prints one JSON line.

Every query is planned and run in full, its rows going to a sink that drops
them. An untimed first pass over the queries lets the JVM compile the code;
then the faster of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tractloom.registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "area_indicators",
    "crosswalk",
    "ind_complaints",
    "ind_violations",
    "ind_evictions",
    "ind_dereg",
    "full_join_indicators",
    "merged_indicators",
    "join_left_fanout",
    "acs_ratios",
    "manual_dedupe",
    "anti_join_chain",
    "geocode_members",
    "choropleth_scale",
    "detail_table",
]


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tractloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites are only kept for error messages, at a cost per expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE:
        run(spark, name, folder)
    runs = [{name: run(spark, name, folder) for name in HEADLINE} for _ in range(2)]
    seconds = {name: round(min(r[name] for r in runs), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(folder).name.removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main()
