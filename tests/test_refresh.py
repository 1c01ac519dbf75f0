"""A store of daily sums: refreshed tables equal recomputed ones."""

import datetime
import shutil
from dataclasses import replace

import fixtures
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tractloom import AreaRules, build_area_indicators
from tractloom.operators import crosswalk
from tractloom.operators.relate import merge_keyed
from tractloom.plans import refresh
from tractloom.plans.area_table import record_indicators
from tractloom.sources import schemas

day = datetime.date.fromisoformat
MORE_COMPLAINTS = [(7, 4, 3002, day("2020-06-01")), (8, 4, 3003, day("2019-03-01")), (9, 4, 3001, None)]
MORE_PROBLEMS = [(20, 7, "EMERGENCY"), (21, 8, "HAZARDOUS"), (22, 5, "EMERGENCY"), (23, 9, "EMERGENCY")]
MORE_VIOLATIONS = [(5, 4, 3003, "B", day("2020-06-01")), (6, 4, 3002, None, day("2019-03-01"))]


def rows(frame):
    return sorted(repr(sorted(r.asDict().items())) for r in frame.collect())


def plus(spark, frame, more, schema):
    return frame.unionByName(spark.createDataFrame(more, schema))


def later(spark, sources):
    """The same tables some time after, with new and late records and a problem that an old complaint got."""
    return replace(
        sources,
        complaints=plus(spark, sources.complaints, MORE_COMPLAINTS, schemas.COMPLAINTS),
        complaint_problems=plus(spark, sources.complaint_problems, MORE_PROBLEMS, schemas.COMPLAINT_PROBLEMS),
        violations=plus(spark, sources.violations, MORE_VIOLATIONS, schemas.VIOLATIONS),
    )


def changed_days(spark, sources):
    return [
        *refresh.record_days(spark.createDataFrame(MORE_COMPLAINTS, schemas.COMPLAINTS), "receiveddate"),
        *refresh.record_days(spark.createDataFrame(MORE_VIOLATIONS, schemas.VIOLATIONS), "inspectiondate"),
        *refresh.problem_days(
            spark.createDataFrame(MORE_PROBLEMS, schemas.COMPLAINT_PROBLEMS), sources.complaints
        ),
    ]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    sources, areas = fixtures.area_sources(spark), fixtures.area_list(spark)
    path = str(tmp_path_factory.mktemp("built") / "sums")
    refresh.build_store(sources, areas, path)
    return sources, areas, path


@pytest.fixture
def setting(built, tmp_path):
    sources, areas, path = built
    shutil.copytree(path, tmp_path / "sums")
    return sources, areas, str(tmp_path / "sums")


def counted(sources, areas, rules=None):
    """The record tables' part of the table, from all records."""
    rules = rules or AreaRules()
    blocks = crosswalk.block_areas(refresh._crosswalk(sources, areas, rules))
    return rows(merge_keyed(record_indicators(sources, blocks, rules)))


def test_a_store_gives_the_table(spark, setting):
    sources, areas, path = setting
    assert rows(refresh.refreshed_area_indicators(sources, areas, path)) == rows(build_area_indicators(sources, areas))
    early = AreaRules(since=None, until=day("2019-02-03"))
    assert rows(refresh.stored_counts(spark, path, early)) == counted(sources, areas, early)
    with pytest.raises(ValueError, match="period"):
        refresh.stored_counts(spark, path, AreaRules(since=None))


def test_new_late_and_repeated_refreshes(spark, setting):
    sources, areas, path = setting
    now = later(spark, sources)
    wanted = counted(now, areas)
    assert wanted != counted(sources, areas)
    days = changed_days(spark, now)
    assert day("2019-05-05") in days and day("2019-03-01") in days
    for _ in range(2):
        refresh.refresh_store(now, areas, path, days)
        assert rows(refresh.stored_counts(spark, path)) == wanted
    refresh.compact_store(spark, path)
    assert rows(refresh.stored_counts(spark, path)) == wanted
    assert refresh.stored_sums(spark, path).groupBy("geoid", "day").count().filter("count > 1").count() == 0
    # Back again: records that are withdrawn leave their days.
    refresh.refresh_store(sources, areas, path, days)
    assert rows(refresh.stored_counts(spark, path)) == counted(sources, areas)
    assert refresh.refresh_store(sources, areas, path, []) is None


def test_tables_without_dates_on_request(spark, setting):
    sources, areas, path = setting
    fewer = replace(sources, evictions=sources.evictions.limit(1), rentstab_v2=sources.rentstab_v2.filter("uc2018 > 4"))
    refresh.refresh_store(fewer, areas, path, [], undated=True)
    assert rows(refresh.stored_counts(spark, path)) == counted(fewer, areas)


def test_a_rebuilt_store_forgets_days_without_records(spark, setting):
    sources, areas, path = setting
    none = replace(sources, violations=sources.violations.limit(0), complaints=sources.complaints.limit(0))
    refresh.build_store(none, areas, path)
    assert rows(refresh.stored_counts(spark, path)) == counted(none, areas)


def test_a_failed_refresh_changes_nothing(spark, setting):
    sources, areas, path = setting
    before = rows(refresh.stored_sums(spark, path))
    class_ = F.when(F.col("violationid") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("class"))
    broken = replace(sources, violations=sources.violations.withColumn("class", class_))
    with pytest.raises((PySparkException, Exception), match="lost"):
        refresh.refresh_store(broken, areas, path, [day("2019-02-03")])
    assert rows(refresh.stored_sums(spark, path)) == before


def test_another_crosswalk_or_other_codes_are_refused(spark, setting):
    sources, areas, path = setting
    moved = replace(sources, parcels=sources.parcels.filter("block <> 3002"))
    with pytest.raises(ValueError, match="build it again"):
        refresh.refresh_store(moved, areas, path, [day("2019-02-03")])
    with pytest.raises(ValueError, match="build it again"):
        refresh.refresh_store(sources, areas, path, [], undated=True, rules=AreaRules(eviction_kind=None))


def test_ranges_of_days_reach_the_scan(spark, tmp_path):
    days = [day("2019-02-03"), day("2019-02-01"), day("2019-02-02"), day("2019-03-01")]
    assert refresh.day_ranges(days) == [
        (day("2019-02-01"), day("2019-02-04")), (day("2019-03-01"), day("2019-03-02")),
    ]
    path = str(tmp_path / "violations")
    spark.createDataFrame(fixtures.VIOLATIONS, schemas.VIOLATIONS).write.parquet(path)
    some = refresh.on_days(spark.read.parquet(path), "inspectiondate", days)
    plan = some._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(inspectiondate,2019-02-01)" in pushed and "LessThan(inspectiondate,2019-02-04)" in pushed
    assert some.count() == 3
    assert refresh.on_days(spark.read.parquet(path), "inspectiondate", []).count() == 0
