import json

import fixtures as fx
import pytest
from fixtures import T1

from tractloom import build_area_indicators
from tractloom.fixed_values import INDICATORS
from tractloom.sources import readers, sinks


def test_area_ids_stay_text(spark, tmp_path):
    path = tmp_path / "areas.csv"
    path.write_text("geoid\n06001000100\n36081054500\n")
    assert [r.geoid for r in readers.read_area_list(spark, str(path)).collect()] == ["06001000100", "36081054500"]


def test_indicator_meta_file(spark, tmp_path):
    path = tmp_path / "meta.csv"
    lines = [f'{o},{g},{n},"{d}",{f}' for o, g, n, d, f in INDICATORS]
    path.write_text("order,var_group,var_name,display_name,val_fmt\n" + "\n".join(lines) + "\n")
    read = readers.read_indicator_meta(spark, str(path)).orderBy("order")
    assert [tuple(r) for r in read.collect()] == INDICATORS
    assert read.schema == readers.standard_indicator_meta(spark).schema


def test_members_file(spark, tmp_path):
    path = tmp_path / "members.json"
    path.write_text(json.dumps({"id": "r1", "Name": "Ana", "E-Mail": "a@x.org", "Address": "1 A St"}) + "\n")
    row = readers.read_members(spark, str(path)).first()
    assert (row["id"], row["Name"], row["E-Mail"], row["Zip code"]) == ("r1", "Ana", "a@x.org", None)


def test_snapshot_is_replaced(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    sinks.write_snapshot(spark.range(5), path)
    sinks.write_snapshot(spark.range(3), path)
    assert sinks.read_snapshot(spark, path).count() == 3


def test_append_creates_then_adds(spark, tmp_path):
    path = str(tmp_path / "rows")
    frame = spark.createDataFrame([("a,b", None), ('12 "B" St, \\x', 1.5)], "s STRING, v DOUBLE")
    sinks.append_csv(frame, path)
    sinks.append_csv(frame, path)
    rows = readers.read_csv(spark, path, "s STRING, v DOUBLE").collect()
    quoted = ('12 "B" St, \\x', 1.5)
    assert sorted((r.s, r.v) for r in rows) == [quoted, quoted, ("a,b", None), ("a,b", None)]


def test_sources_from_parquet_copies(spark, tmp_path):
    sources = fx.area_sources(spark)
    for role, (table, _) in readers._RELATIONS.items():
        getattr(sources, role).write.parquet(str(tmp_path / table))
    survey_path = str(tmp_path / "survey")
    sources.survey.selectExpr("*", "2018 AS year").write.partitionBy("year").parquet(survey_path)
    survey = readers.read_survey(spark, survey_path, "36", "081", {"year": 2018})
    read = readers.read_area_sources(spark, str(tmp_path), survey)
    built = build_area_indicators(read, fx.area_list(spark))
    direct = build_area_indicators(sources, fx.area_list(spark))
    assert {tuple(r) for r in built.collect()} == {tuple(r) for r in direct.collect()}
    snapshot = str(tmp_path / "snapshot")
    sinks.write_snapshot(built, snapshot)
    again = sinks.read_snapshot(spark, snapshot)
    assert again.columns == built.columns
    assert again.filter(f"geoid = '{T1}'").first() == built.filter(f"geoid = '{T1}'").first()


def test_database_reads_are_split(spark):
    assert readers.jdbc_options("t", ("id", 0, 100, 8)) == {
        "dbtable": "t", "partitionColumn": "id", "lowerBound": "0", "upperBound": "100", "numPartitions": "8",
    }
    with pytest.raises(ValueError, match="hpd_complaints"):
        readers.read_database_sources(spark, "jdbc:none", fx.survey(spark), {})


def test_doubled_quotes_in_a_hand_made_file(spark, tmp_path):
    path = tmp_path / "manual.csv"
    path.write_text('uid,address,latitude,longitude\nm1,"12 ""B"" St, QN",40.5,-73.5\nm2,"",,\n')
    rows = readers.read_overrides(spark, str(path)).collect()
    assert {(r.uid, r.latitude, r.longitude) for r in rows} == {("m1", 40.5, -73.5), ("m2", None, None)}
