"""Snapshots that survive a failed write, splits of equal depth, shapes from files."""

import re
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tractloom.plans import map_views
from tractloom.sources import readers, sinks


def test_a_failed_write_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    good = spark.range(100).select(F.col("id").cast("string").alias("geoid"), "id")
    assert sinks.write_snapshot(good, path) == 1
    broken = good.withColumn("id", F.when(F.col("id") == 70, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises((PySparkException, Exception), match="lost"):
        sinks.write_snapshot(broken, path)
    assert sinks.read_snapshot(spark, path).count() == 100
    more = good.unionByName(good.withColumn("geoid", F.concat(F.lit("x"), "geoid")))
    number = sinks.write_snapshot(more, path)
    assert sinks.read_snapshot(spark, path).count() == 200
    assert sinks.read_snapshot(spark, path, 1).count() == 100
    whole = sinks.snapshot_versions(spark, path)
    assert whole[1] and whole[number] and sum(whole.values()) == 2
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, path, 99)


def test_a_table_can_be_replaced_by_what_is_read_from_it(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    sinks.write_snapshot(spark.range(5).toDF("geoid"), path)
    sinks.write_snapshot(sinks.read_snapshot(spark, path).filter("geoid > 1"), path)
    assert sorted(r.geoid for r in sinks.read_snapshot(spark, path).collect()) == [2, 3, 4]


def test_a_lookup_touches_the_files_of_its_range_only(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(0, 40000, 1, 8).select(F.format_string("%06d", F.col("id") * 7 % 40000).alias("geoid"), "id")
        sinks.write_snapshot(rows, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled") if old is None else spark.conf.set(
            "spark.sql.adaptive.coalescePartitions.enabled", old
        )
    table = sinks.read_snapshot(spark, path)
    spans = table.groupBy(F.input_file_name()).agg(F.min("geoid").alias("a"), F.max("geoid").alias("b")).collect()
    assert len(spans) > 1
    assert sum(s.a <= "012345" <= s.b for s in spans) == 1
    found = table.filter(F.col("geoid") == "012345")
    assert re.search(r"PushedFilters: \[.*EqualTo\(geoid,012345\)", found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == 1


def test_splits_hold_equal_numbers_of_a_skewed_key(spark):
    skewed = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * F.col("id")).alias("k"))
    keys = skewed.unionByName(spark.createDataFrame([(None,)] * 10, "k long"))
    splits = readers.equal_splits(keys, "k", 10)
    assert 6 <= len(splits) <= 10
    counts = [keys.filter(s).count() for s in splits]
    assert sum(counts) == keys.count()
    # The hot value is a third; no other part has more than about its share.
    assert sorted(counts)[-1] < 0.45 * sum(counts) and sorted(counts)[-2] < 0.15 * sum(counts)
    assert readers.equal_splits(keys.limit(0), "k", 4) == ["1 = 1"]
    assert readers.equal_splits(spark.range(1).toDF("k"), "k", 4) == ["k < 0 OR k IS NULL", "k >= 0"]


@pytest.fixture
def geospatial(spark):
    spark.conf.set("spark.sql.geospatial.enabled", "true")
    yield
    spark.conf.unset("spark.sql.geospatial.enabled")


def test_shapes_reach_a_layer(spark, tmp_path, geospatial):
    path = str(tmp_path / "shapes")
    point = lambda x, y: struct.pack("<BIdd", 1, 1, x, y)
    rows = [("a", bytearray(point(1.0, 2.0))), ("b", bytearray(point(3.0, 4.0)))]
    spark.createDataFrame(rows, "geoid string, wkb binary").write.parquet(path)
    shapes = readers.read_shapes(spark, path)
    assert shapes.schema["geometry"].dataType.typeName() == "geometry"
    table = shapes.join(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "geoid string, v double"), "geoid")
    layer = map_views.choropleth(table, "v").select("geoid", "pos", F.st_asbinary("geometry").alias("wkb"))
    assert sorted((r.geoid, r.pos, bytes(r.wkb)) for r in layer.collect()) == [
        ("a", 0.0, point(1.0, 2.0)), ("b", 1.0, point(3.0, 4.0)),
    ]
