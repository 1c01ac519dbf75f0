"""Work that is avoided: filters of keys, running sums in place of pairs, copies for popular keys only, one scan."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_plans import executed_plan, plan_of, setting  # noqa: F401

from tractloom import build_area_indicators
from tractloom.operators import counting, crosswalk, keyfilter, relate
from tractloom.plans import map_views
from tractloom.plans import members as mod
from tractloom.registry import views
from tractloom.sources import readers


def blocks_of(spark, folder):
    return crosswalk.block_areas(
        crosswalk.block_crosswalk(views.parcels(spark, folder), views.area_list(spark, folder))
    )


# Filters of keys


@pytest.mark.parametrize("kind", ["int", "bigint", "string"])
def test_a_key_filter_loses_no_key_and_lets_few_others_pass(spark, kind):
    keys = spark.range(0, 40000, 4, 3).select(F.col("id").cast(kind).alias("k"))
    rows = spark.range(0, 40000, 1, 3).select(F.col("id").cast(kind).alias("k"), F.lit("x").alias("word"))
    filter_ = keyfilter.key_filter(keys, "k", 1 << 12)
    kept = keyfilter.possibly_in(rows, "k", filter_, 1 << 12)
    assert kept.columns == ["k", "word"]
    found = {int(r.k) for r in kept.collect()}
    assert found >= set(range(0, 40000, 4))
    assert len(found) < 10000 + 0.02 * 30000
    assert filter_.count() <= 1 << 12


def test_filters_of_parts_merge_and_a_full_one_only_stops_pruning(spark):
    first, second = spark.range(0, 500), spark.range(500, 1000)
    both = keyfilter.key_filter(first, "id").unionByName(keyfilter.key_filter(second, "id"))
    merged = both.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    assert sorted(merged.collect()) == sorted(keyfilter.key_filter(spark.range(1000), "id").collect())
    full = keyfilter.key_filter(spark.range(20000), "id", 2)
    assert full.count() == 2
    assert keyfilter.possibly_in(spark.range(30000), "id", full, 2).count() == 30000


def test_problems_are_pruned_before_their_aggregate_and_exchange(spark, folder, setting):  # noqa: F811
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    counted = counting.complaint_counts(
        views.complaints(spark, folder), views.complaint_problems(spark, folder), blocks_of(spark, folder), since=views.SINCE
    )
    plan = executed_plan(counted)
    lines = plan.splitlines()
    probe = next(i for i, line in enumerate(lines) if "BroadcastHashJoin [probe_word" in line)
    above = [i for i, line in enumerate(lines[:probe]) if "Exchange hashpartitioning(complaintid" in line]
    assert above and "HashAggregate" in "".join(lines[above[-1] : probe])
    # The filter reads the exchange of complaints that the join reads, too.
    assert "ReusedExchange" in "".join(lines[probe:])
    assert len(re.findall(r"FileScan parquet .*orders.parquet", plan)) == 1


# Running sums


def test_running_sums_equal_pairs(spark):
    rng = random.Random(1)
    blocks = spark.createDataFrame([(400001, "a"), (400002, "b")], "block_id int, geoid string")
    before = [(rng.choice(["4000010001", "4000020001", "4000020002", "4000990001", None]), rng.choice([None, 0, 1, 3, 8]))
              for _ in range(60)]
    after = [(rng.choice(["4000010001", "4000020001", "4000020003", None]), rng.choice([None, 0, 1, 2, 9])) for _ in range(60)]
    found = counting.unit_losses(
        spark.createDataFrame(before, "ucbbl string, unitsstab2007 int"),
        spark.createDataFrame(after, "ucbbl string, uc2018 int"),
        blocks,
    ).collect()
    wanted = {}
    for area, block in (("a", "400001"), ("b", "400002")):
        pairs = [
            (b, a)
            for key, b in before if key and key.startswith(block) and b
            for other, a in after if other == key and a is not None and a <= b
        ]
        lost, had = sum(b - a for b, a in pairs), sum(b for b, _ in pairs)
        wanted[area] = (float(lost), lost / had)
    assert {r.geoid: (r.dereg_units, r.dereg_pct) for r in found} == wanted


def test_a_building_with_very_many_values_on_both_sides_ends(spark):
    n = 100_000
    blocks = spark.createDataFrame([(400001, "a")], "block_id int, geoid string")
    ids = spark.range(1, n + 1, 1, 8)
    before = ids.select(F.lit("4000010001").alias("ucbbl"), F.col("id").cast("int").alias("unitsstab2007"))
    after = ids.select(F.lit("4000010001").alias("ucbbl"), F.col("id").cast("int").alias("uc2018"))
    losses = counting.unit_losses(before, after, blocks)
    plan = plan_of(losses)
    # Values are counted before they move, and no join pairs them.
    assert "Join [ucbbl" not in plan and "partial_sum" in plan
    row = losses.first()
    lost, had = sum(b * (b - 1) // 2 for b in range(1, n + 1)), sum(b * b for b in range(1, n + 1))
    assert (row.dereg_units, row.dereg_pct) == (float(lost), lost / had)


# Popular keys


def test_only_popular_keys_are_copied(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
    rows = spark.range(0, 60000, 1, 8).select(key.alias("my key"), F.col("id").alias("by"))
    table = rows.select("my key").distinct().withColumn("value", F.length("my key"))
    hot = spark.range(1).select(relate.popular_keys(rows, "my key").alias("k")).first().k
    assert hot == ["hot"]
    even = rows.filter("`my key` <> 'hot'")
    assert spark.range(1).select(relate.popular_keys(even, "my key").alias("k")).first().k == []
    assert spark.range(1).select(relate.popular_keys(rows.limit(0), "my key").alias("k")).first().k in ([], None)
    joined = relate.spread_left_join(rows, table, "my key", "by", 5)
    assert joined.count() == 60000 and joined.filter(F.col("value") != F.length("my key")).isEmpty()
    # Rows that the table's side brings to the join: one each, but the spread for the popular key.
    parts = relate.spread_left_join(table.withColumn("by", F.lit(0)), table, "my key", "by", 5)
    assert parts.count() == table.count()


def test_a_key_that_is_null_or_absent_joins_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, by int")
    table = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    joined = relate.spread_left_join(rows, table, "k", "by", share=0.2)
    assert sorted((r.by, r.v) for r in joined.collect()) == [(1, None), (2, None), (3, 1)]


# Override files


def test_lines_of_override_files_are_whole_numbers_folded_in_a_hash_table(spark, tmp_path):
    import os

    path = tmp_path / "overrides"
    path.mkdir()
    for name, age, lines in (("b.csv", 100, "1,x,1.0,2.0\n2,x,3.0,4.0"), ("a.csv", 200, "1,x,5.0,6.0\n3,x,7.0,8.0"),
                             ("c d.csv", 200, "3,x,9.0,9.0\n3,x,8.0,8.0\n4,x,,")):
        (path / name).write_text(f"uid,address,latitude,longitude\n{lines}\n")
        os.utime(path / name, (age, age))
    first = mod.first_overrides(readers.read_overrides(spark, str(path)))
    plan = executed_plan(first)
    assert "SortAggregate" not in plan and "HashAggregate" in plan and "ObjectHashAggregate" not in plan
    rows = {r.uid: (r.latitude, r.longitude) for r in first.collect()}
    assert rows == {"1": (1.0, 2.0), "2": (3.0, 4.0), "3": (7.0, 8.0), "4": (None, None)}
    ranks = {r.file.rsplit("/", 1)[1]: r["rank"] for r in readers.file_ranks(spark, str(path)).collect()}
    assert ranks == {"b.csv": 1, "a.csv": 2, "c%20d.csv": 3} or ranks == {"b.csv": 1, "a.csv": 2, "c d.csv": 3}


# Layers


def test_a_layer_and_all_layers_scan_each_record_table_once(spark, folder):
    table = build_area_indicators(views.area_sources(spark, folder), views.area_list(spark, folder), views.RULES)
    flagship = len(re.findall("Scan parquet", executed_plan(table)))
    layers = map_views.choropleth_layers(table)
    assert len(re.findall("Scan parquet", executed_plan(layers))) == flagship
    one = executed_plan(map_views.choropleth(table, "marsh_evic_num"))
    assert len(re.findall("Scan parquet", one)) <= flagship
    assert len(re.findall(r"events.parquet", one.split("Initial Plan")[0])) == 1
    assert layers.count() == table.count() * (len(table.columns) - 1)
