import datetime

import fixtures as fx
import pytest
from fixtures import T1, T2, T3
from pyspark.sql import functions as F

from tractloom import AreaRules, build_area_indicators
from tractloom.fixed_values import INDICATORS, SURVEY_COLUMNS
from tractloom.operators import counting, crosswalk, relate, reshape
from tractloom.sources import schemas


@pytest.fixture(scope="module")
def table(spark):
    built = build_area_indicators(fx.area_sources(spark), fx.area_list(spark))
    return {r.geoid: r.asDict() for r in built.collect()}


def test_columns(spark):
    columns = build_area_indicators(fx.area_sources(spark), fx.area_list(spark)).columns
    assert len(columns) == 35
    assert columns[0] == "geoid"
    assert columns[1:16] == SURVEY_COLUMNS
    described = {name for _, _, name, _, _ in INDICATORS}
    assert set(columns) - described == {"geoid", "pop_rt"}
    assert described <= set(columns)


def test_one_row_per_surveyed_listed_area(table):
    assert set(table) == {T1, T2, T3}


EXPECTED = {
    T1: {
        "pop_rt": 500.0, "comp_nonemerg_num": 1.0, "comp_emerg_num": 2.0, "comp_immed_num": 1.0,
        "comp_haz_num": 0.0, "viol_a_num": None, "viol_b_num": None, "viol_c_num": None,
        "marsh_evic_num": 2.0, "dereg_units": None, "dereg_pct": None, "comp_emerg_rt": 1.0,
        "marsh_evic_rt": 1.0, "rent_burden_30p_pct": 50 / 90, "rent_burden_50p_pct": 15 / 90,
        "renter_pct": 0.5, "renter_fam_pov_pct": None,
    },
    T2: {
        "pop_rt": None, "comp_nonemerg_num": 0.0, "comp_emerg_num": 0.0, "comp_immed_num": 0.0,
        "comp_haz_num": 1.0, "viol_a_num": 1.0, "viol_b_num": 0.0, "viol_c_num": 1.0,
        "marsh_evic_num": None, "dereg_units": 6.0, "dereg_pct": 0.6, "comp_emerg_rt": None,
        "marsh_evic_rt": None, "rent_burden_30p_pct": None, "rent_burden_50p_pct": None,
        "renter_pct": 0.0, "renter_white_pct": None,
    },
    T3: {
        "pop_rt": 320.0, "comp_nonemerg_num": None, "comp_emerg_num": None, "comp_immed_num": None,
        "comp_haz_num": None, "viol_a_num": None, "viol_b_num": None, "viol_c_num": None,
        "marsh_evic_num": None, "dereg_units": 0.0, "dereg_pct": 0.0, "comp_emerg_rt": None,
        "marsh_evic_rt": None, "rent_burden_30p_pct": None, "rent_burden_50p_pct": None,
    },
}


@pytest.mark.parametrize("geoid", [T1, T2, T3])
def test_values(table, geoid):
    row = table[geoid]
    assert {name: row[name] for name in EXPECTED[geoid]} == EXPECTED[geoid]


def test_shapes_are_carried_along(spark):
    built = build_area_indicators(fx.area_sources(spark, shapes=True), fx.area_list(spark))
    assert {r.geoid: r.geometry for r in built.select("geoid", "geometry").collect()} == {
        T1: "POLYGON EMPTY", T2: "POLYGON EMPTY", T3: None,
    }


def test_upper_date_bound_is_optional(spark):
    rules = AreaRules(until=datetime.date(2020, 1, 1))
    built = build_area_indicators(fx.area_sources(spark), fx.area_list(spark), rules)
    row = built.filter(F.col("geoid") == T1).first()
    assert (row.comp_immed_num, row.comp_emerg_num) == (0.0, 2.0)


def _crosswalk(spark, borough="QN"):
    return crosswalk.block_crosswalk(fx.area_sources(spark).parcels, fx.area_list(spark), borough)


def test_crosswalk(spark):
    assert {tuple(r) for r in _crosswalk(spark).collect()} == {
        ("4", "03001", T1), ("4", "03002", T2), ("4", "03003", T1), ("4", "03004", T3),
    }


def test_area_ids(spark):
    keyed = crosswalk.keyed_parcels(fx.area_sources(spark).parcels)
    ids = {(r.borocode, r.block): r.geoid for r in keyed.collect()}
    assert ids["3", "03001"] == "36047054500"
    assert ids["4", "03006"] == "36081053101"
    assert ids["9", "03007"] is None


def test_blocks_that_are_no_number_are_left_out(spark):
    parcels = spark.createDataFrame(
        [("4", "3001", "0545", "QN"), ("4", "3A", "0545", "QN"), ("4", None, "0545", "QN")],
        "borocode STRING, block STRING, tract2010 STRING, borough STRING",
    )
    found = crosswalk.block_crosswalk(parcels, fx.area_list(spark)).collect()
    assert [tuple(r) for r in found] == [("4", "03001", T1)]


def test_dirty_record_keys_match_nothing(spark):
    blocks = crosswalk.block_areas(_crosswalk(spark))
    dirty = spark.createDataFrame(
        [("x", "3001", "A"), ("4", "103001", "A"), ("4", None, "A"), ("4", "-1", "A"), (" 4", "03002", "A"),
         ("99999999999", "3001", "A")],
        "boroid STRING, block STRING, class STRING",
    ).withColumn("inspectiondate", F.lit(datetime.date(2019, 5, 5)))
    assert [r.asDict() for r in counting.violation_counts(dirty, blocks).collect()] == [
        {"geoid": T2, "viol_a_num": 1, "viol_b_num": 0, "viol_c_num": 0}
    ]
    lots = spark.createDataFrame([("4030",), ("40300x",), (None,), ("+403001",), ("403001",), ("4030010",)], "bbl STRING")
    lots = lots.withColumn("residentialcommercialind", F.lit("RESIDENTIAL"))
    assert [tuple(r) for r in counting.eviction_counts(lots, blocks).collect()] == [(T1, 2)]


def test_repeated_complaints_and_untyped_problems(spark):
    """Each complaint row counts all problems; a NULL type is neither 0 nor 1."""
    blocks = crosswalk.block_areas(_crosswalk(spark))
    when = datetime.date(2019, 2, 2)
    complaints = spark.createDataFrame(
        [(1, 4, 3001, when), (1, 4, 3001, when), (1, 4, 3002, when), (2, 4, 3004, when)], schemas.COMPLAINTS
    )
    problems = spark.createDataFrame(
        [(1, 1, "EMERGENCY"), (2, 1, "EMERGENCY"), (3, 1, None), (4, 2, None)], schemas.COMPLAINT_PROBLEMS
    )
    rows = counting.complaint_counts(complaints, problems, blocks).collect()
    assert {r.geoid: (r.comp_emerg_num, r.comp_haz_num) for r in rows} == {
        T1: (4, 0), T2: (2, 0), T3: (None, None),
    }


def test_full_join_and_merge_agree(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "geoid STRING, a INT")
    b = spark.createDataFrame([("y", 3), ("z", None)], "geoid STRING, b INT")
    c = spark.createDataFrame([("w", 4.5)], "geoid STRING, c DOUBLE")
    joined = relate.full_join_on([a, b, c])
    merged = relate.merge_keyed([a, b, c])
    assert joined.columns == merged.columns == ["geoid", "a", "b", "c"]
    wanted = {("x", 1, None, None), ("y", 2, 3, None), ("z", None, None, None), ("w", None, None, 4.5)}
    assert {tuple(r) for r in joined.collect()} == wanted
    assert {tuple(r) for r in merged.collect()} == wanted


def test_survey_slice_and_names(spark):
    cells = fx.survey(spark).withColumns({"year": F.lit(2018), "survey": F.lit("acs5")})
    queens = reshape.survey_slice(cells, "36", "081", {"year": 2018, "survey": "acs5"})
    wide = reshape.pivot_survey(queens).withColumnRenamed("geoid", "GEOID").withColumn("NAME", F.lit("x"))
    assert "pop_numE" in wide.columns and "pop_numM" in wide.columns
    plain = reshape.plain_estimates(wide)
    assert plain.columns[:3] == ["geoid", "pop_num", "occ_units"]
    assert len(plain.columns) == 26
    assert {r.geoid for r in plain.collect()} == {T1, T2, T3, "36081099900"}
    assert reshape.survey_slice(cells, "36", "081", {"year": 2017}).isEmpty()
    with pytest.raises(ValueError):
        reshape.survey_slice(cells, county="081")
