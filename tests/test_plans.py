"""What the plans must look like to hold up on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from tractloom import build_area_indicators, resolve_cascade
from tractloom.operators import counting, crosswalk
from tractloom.plans import members as mod
from tractloom.registry import views
from tractloom.registry.queries import QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def executed_plan(frame):
    frame.collect()
    return plan_of(frame).split("== Initial Plan ==")[0]


@pytest.fixture
def setting(spark):
    """Change session settings for one test."""
    changed = []

    def change(key, value):
        changed.append((key, spark.conf.get(key, None)))
        spark.conf.set(key, value)

    yield change
    for key, old in reversed(changed):
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert word not in plan


def test_one_crosswalk_serves_all_records(spark, folder):
    built = build_area_indicators(views.area_sources(spark, folder), views.area_list(spark, folder), views.RULES)
    plan = executed_plan(built)
    assert len(re.findall(r"BroadcastHashJoin \[block_id", plan)) == 5
    assert len(re.findall(r"ReusedExchange \[block_id", plan)) == 4


def test_filters_and_columns_reach_the_scan(spark, folder):
    blocks = crosswalk.block_areas(
        crosswalk.block_crosswalk(views.parcels(spark, folder), views.area_list(spark, folder))
    )
    plan = plan_of(counting.violation_counts(views.violations(spark, folder), blocks, since=views.SINCE))
    scan = next(line for line in plan.splitlines() if "lineitem" in line)
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01" in scan
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in scan
    plan = plan_of(counting.eviction_counts(views.evictions(spark, folder), blocks, "purchase"))
    scan = next(line for line in plan.splitlines() if "events" in line)
    assert "EqualTo(event_type,purchase)" in scan


def test_merging_indicators_adds_no_shuffle(spark, folder, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = plan_of(QUERIES["merged_indicators"](spark, folder))
    above = plan[: plan.index("Union")]
    assert "Exchange" not in above


def test_crosswalk_takes_one_exchange_and_no_sort(spark, folder):
    """Block keys and areas are whole numbers until the result, folded in a hash table."""
    plan = plan_of(QUERIES["crosswalk"](spark, folder))
    assert "SortAggregate" not in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_later_stock_is_pruned_before_it_moves(spark, folder):
    """Only buildings on mapped blocks are grouped; two exchanges feed the join."""
    blocks = crosswalk.block_areas(
        crosswalk.block_crosswalk(views.parcels(spark, folder), views.area_list(spark, folder))
    )
    after = views.rentstab_summary(spark, folder).withColumnRenamed("unitsstab2007", "uc2018")
    plan = plan_of(counting.unit_losses(views.rentstab_summary(spark, folder), after, blocks))
    assert len(re.findall(r"BroadcastHashJoin \[block_id", plan)) == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_building_a_query_starts_no_job(spark, folder, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"building-{name}", name)
    try:
        QUERIES[name](spark, folder)
        assert not tracker.getJobIdsForGroup(f"building-{name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_popular_address_is_split(spark, setting):
    """A third of the members share an address; the lookup still runs as several tasks."""
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1KB")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.1")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4KB")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.shuffle.partitions", "16")
    number = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
    people = spark.range(0, 30000, 1, 8).select(
        F.col("id").cast("string").alias("uid"),
        F.lit("n").alias("name"),
        *[F.lit(None).cast("string").alias(c) for c in ("pronouns", "phone", "email")],
        F.concat(number.cast("string"), F.lit(" Long Street Name, 11385")).alias("address"),
    )
    reference = people.select(
        F.col("address").alias("q"),
        F.lit("1").alias("house_number"),
        F.lit("LONG STREET").alias("street"),
        F.lit("11385").alias("zip"),
        F.lit(40.0).alias("latitude"),
        F.lit(-73.0).alias("longitude"),
    )
    nobody = spark.createDataFrame([], "line INT, uid STRING, latitude DOUBLE, longitude DOUBLE")
    placed = resolve_cascade(people, nobody, reference).placed
    plan = executed_plan(placed.select("uid", "latitude", "clean_address"))
    assert re.search(r"SortMergeJoin\(skew=true\) \[address", plan)
    counted = placed.groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in counted} == {"attempt 1": 30000}


@pytest.mark.parametrize("spread", [1, 3, 16])
def test_spread_does_not_change_the_answer(spark, folder, spread):
    tables = [f(spark, folder) for f in (views.members, views.overrides, views.address_reference)]
    usual = mod.resolve_cascade(*tables).placed
    other = mod.resolve_cascade(*tables, spread=spread).placed
    assert usual.count() == other.count()
    assert usual.exceptAll(other).isEmpty()


def test_hot_complaint_and_hot_block_are_combined_before_the_shuffle(spark, setting):
    """One complaint has a third of the problems and one block a third of the complaints."""
    n = 30000
    ids = spark.range(0, n, 1, 8)
    third = F.col("id") % 3 == 0
    complaints = ids.select(
        F.col("id").cast("int").alias("complaintid"),
        F.lit(4).alias("boroughid"),
        F.when(third, F.lit(1)).otherwise(F.col("id") % 50).cast("int").alias("block"),
        F.to_date(F.lit("2019-06-06")).alias("receiveddate"),
    )
    problems = ids.select(
        F.when(third, F.lit(0)).otherwise(F.col("id")).cast("int").alias("complaintid"),
        F.lit("EMERGENCY").alias("type"),
    )
    blocks = spark.range(50).select(
        (F.col("id") + 400000).cast("int").alias("block_id"),
        F.concat(F.lit("3608100"), (F.col("id") % 2).cast("string")).alias("geoid"),
    )
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    counted = counting.complaint_counts(complaints, problems, F.broadcast(blocks))
    plan = executed_plan(counted)
    assert "partial_sum" in plan and "partial_count" in plan
    assert counted.agg(F.sum("comp_emerg_num")).first()[0] == n
