"""Time the record queries on many copies of the test tables; prints one JSON line.

    python growth.py COPIES [--hot] [--folder FOLDER]

Copies have shifted keys, so distinct keys grow with the rows. With --hot a third of all rows of the record tables
goes to one complaint, block and user. The copy is made once, in a new folder that is printed and left in place;
--folder uses one made before. Every query runs twice in the session and the second run counts. DuckDB answers the
same questions on the same files in the last column.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tractloom.registry.oracle import ORACLE_SQL  # noqa: E402
from tractloom.registry.queries import QUERIES  # noqa: E402

TIMED = [
    "area_indicators", "crosswalk", "ind_complaints", "ind_violations", "ind_evictions", "ind_dereg",
    "join_left_fanout", "manual_dedupe", "geocode_members", "detail_table",
]
#: Key columns of the tables that are copied; nation stays as it is.
KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey"],
    "events": ["event_id", "user_id"],
    "part": ["p_partkey"],
}
#: Of these a third of the rows gets the key 1.
HOT = {"orders": ["o_custkey"], "lineitem": ["l_orderkey", "l_partkey"], "events": ["user_id"]}


def copied(table: DataFrame, name: str, copies: int, hot: bool) -> DataFrame:
    spans = table.agg(*[(F.max(k) + 1).alias(k) for k in KEYS[name]]).first()
    each = table.crossJoin(F.broadcast(table.sparkSession.range(copies).withColumnRenamed("id", "copy")))
    shifted = each.withColumns({k: F.col(k) + F.col("copy") * spans[k] for k in KEYS[name]}).drop("copy")
    if hot and name in HOT:
        third = F.xxhash64(*KEYS[name], F.rand(7)) % 3 == 0
        shifted = shifted.withColumn("third", third)
        shifted = shifted.withColumns({k: F.when(F.col("third"), F.lit(1)).otherwise(F.col(k)) for k in HOT[name]})
        shifted = shifted.drop("third")
    return shifted


def main() -> None:
    asked = argparse.ArgumentParser()
    asked.add_argument("copies", type=int)
    asked.add_argument("--hot", action="store_true")
    asked.add_argument("--folder")
    args = asked.parse_args()
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.autoBroadcastJoinThreshold", "1m")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = args.folder
    if folder is None:
        folder = tempfile.mkdtemp(prefix="growth-")
        spark.read.parquet(f"{source}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
        for name in KEYS:
            table = spark.read.parquet(f"{source}/{name}.parquet")
            copied(table, name, args.copies, args.hot).write.parquet(f"{folder}/{name}.parquet")
    seconds = {}
    for name in TIMED:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 2)
    spark.stop()

    import duckdb

    duck = duckdb.connect()
    for name in [*KEYS, "nation"]:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    plain = {}
    for name in ("area_indicators", "ind_complaints", "ind_dereg", "join_left_fanout"):
        start = time.perf_counter()
        duck.execute(ORACLE_SQL[name]).fetchall()
        plain[name] = round(time.perf_counter() - start, 2)
    print(json.dumps({"copies": args.copies, "hot": args.hot, "folder": folder, "spark": seconds, "duckdb": plain}))


if __name__ == "__main__":
    main()
