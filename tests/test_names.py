"""Column names with blanks, dots and reserved words, shapes, and types that are not as declared."""

import fixtures as fx
import pytest
from pyspark.sql import functions as F

from tractloom import AreaRules
from tractloom.operators import crosswalk, projection, reshape
from tractloom.sources import readers


def test_rates_of_oddly_named_columns_beside_a_shape(spark):
    frame = spark.createDataFrame(
        [("a", 2, 3, 4, "POLYGON", 50)], "geoid STRING, `my col_num` INT, `a.b_num` INT, order_num INT, geometry STRING, `group by` INT"
    )
    row = projection.add_rates(frame, "group by").first().asDict()
    assert (row["my col_rt"], row["a.b_rt"], row["order_rt"], row["geometry"]) == (4.0, 6.0, 8.0, "POLYGON")


def test_pivot_takes_any_code_and_name(spark):
    survey = spark.createDataFrame([("g", "it's", 1.0, 0.5)], "geoid STRING, variable STRING, estimate DOUBLE, moe DOUBLE")
    row = reshape.pivot_survey(survey, {"my share.": "it's"}).first().asDict()
    assert (row["my share.E"], row["my share.M"]) == (1.0, 0.5)


def test_borough_codes_must_form_a_key(spark):
    for code in ("10", "0", "x", ""):
        with pytest.raises(ValueError, match="one digit"):
            AreaRules(boroughs={code: "061"})


def test_tracts_with_letters_keep_their_place(spark):
    parcels = spark.createDataFrame(
        [("4", 7, "01B", "QN"), ("4", 7, "01A", "QN"), ("4", 8, "2", "QN"), ("4", 8, "01", "QN"), ("x", 8, "01", "QN"),
         ("4", 9, "é", "QN"), ("4", 9, None, "QN")],
        "borocode STRING, block INT, tract2010 STRING, borough STRING",
    )
    listed = [f"36081{t.ljust(6, '0')}" for t in ("01A", "01B", "2", "01")]
    areas = spark.createDataFrame([(g,) for g in [*listed, "36061010000", "99"]], "geoid STRING")
    rows = crosswalk.block_crosswalk(parcels, areas, borough="QN").collect()
    assert {tuple(r) for r in rows} == {("4", "00007", "3608101A000"), ("4", "00008", "36081010000")}


def test_a_wrong_type_is_named(spark, tmp_path):
    for role, (table, _) in readers._RELATIONS.items():
        frame = getattr(fx.area_sources(spark), role)
        if role == "complaints":
            frame = frame.withColumn("receiveddate", F.col("receiveddate").cast("string"))
        frame.write.parquet(str(tmp_path / table))
    with pytest.raises(TypeError, match="hpd_complaints.receiveddate should be date, but is string"):
        readers.read_area_sources(spark, str(tmp_path), fx.survey(spark))


def test_address_reference_file(spark, tmp_path):
    path = tmp_path / "known.csv"
    path.write_text('q,house_number,street,zip,latitude,longitude\n"1 A St, QN",1,A STREET,01234,40.5,-73.5\n')
    row = readers.read_address_reference(spark, str(path)).first()
    assert (row.q, row.zip, row.latitude) == ("1 A St, QN", "01234", 40.5)
