import fixtures as fx
import pytest
from fixtures import T1, T2, T3
from pyspark.sql import functions as F

from tractloom import (
    build_area_indicators,
    choropleth,
    choropleth_legend,
    detail_table,
    detail_tables,
    legend_breaks,
    undescribed_columns,
    variable_menu,
)
from tractloom.functions.numeric import display_text
from tractloom.sources.readers import standard_indicator_meta


@pytest.fixture(scope="module")
def table(spark):
    built = build_area_indicators(fx.area_sources(spark, shapes=True), fx.area_list(spark))
    return built.cache()


@pytest.mark.parametrize(
    ("value", "style", "text"),
    [
        (1234.5, "num", "1,234"),
        (0.1234, "pct", "12.3%"),
        (2000.4, "cur", "$2,000"),
        (-2000.4, "cur", "-$2,000"),
        (1234.56, "rt", "1,234.6"),
        (None, "num", "—"),
        (float("nan"), "pct", "—"),
        (float("-inf"), "cur", "—"),
    ],
)
def test_display_text(spark, value, style, text):
    frame = spark.createDataFrame([(value, style)], "v DOUBLE, s STRING")
    assert frame.select(display_text(F.col("v"), F.col("s"))).first()[0] == text


def test_menu(spark):
    menu = variable_menu(standard_indicator_meta(spark).repartition(5)).orderBy("order").collect()
    assert len(menu) == 33
    assert tuple(menu[0]) == (0, "Totals: Total Units", "occ_units")
    assert ("Renters: Renter Units", "occ_renter_units") in [tuple(r)[1:] for r in menu]
    assert variable_menu(standard_indicator_meta(spark), exclude_prefix="Totals").count() == 31


def test_detail_table_of_one_area(spark, table):
    rows = detail_table(table, standard_indicator_meta(spark), T2).collect()
    assert [r.order for r in rows] == list(range(33))
    text = {r.display_name: r.value_text for r in rows if r.var_group.startswith(("Totals", "Dereg", "Marsh"))}
    assert text == {
        "Total Units": "300",
        "Total Population": "900",
        "Deregulated Units Number": "6",
        "Deregulated Units Percent": "60.0%",
        "Marshall Eviction Number": "—",
        "Marshall Eviction Rate": "—",
    }


def test_detail_tables_agree_with_single_ones(spark, table):
    meta = standard_indicator_meta(spark)
    extra = spark.createDataFrame([(40, "Other", "no_such_column", "Nothing", "num")], meta.schema)
    meta = meta.unionByName(extra)
    every = detail_tables(table, meta)
    assert every.count() == 3 * 33
    assert [r.var_name for r in undescribed_columns(table, meta).collect()] == ["no_such_column"]
    for geoid in (T1, T2, T3):
        one = detail_table(table, meta, geoid).collect()
        assert every.filter(F.col("geoid") == geoid).drop("geoid").orderBy("order").collect() == one[:-1]
        assert one[-1].value_text == "—"


def test_scale(table):
    rows = {r.geoid: (r.value, r.pos, r.is_missing) for r in choropleth(table, "occ_units").collect()}
    assert rows[T1] == (400.0, 1.0, False)
    assert rows[T3] == (80.0, 0.0, False)
    assert rows[T2][1] == (300 - 80) / (400 - 80)
    turned = {r.geoid: r.pos for r in choropleth(table, "occ_units", reverse=True).collect()}
    assert turned == {g: 1.0 - pos for g, (_, pos, _) in rows.items()}


def test_scale_of_a_single_value_and_of_none(table):
    rows = {r.geoid: (r.pos, r.is_missing) for r in choropleth(table, "marsh_evic_num").collect()}
    assert rows == {T1: (0.5, False), T2: (None, True), T3: (None, True)}
    assert {r.pos for r in choropleth(table, "renter_fam_pov_pct").collect()} == {None}


def test_legend(table):
    assert [r.value for r in choropleth_legend(table, "occ_units").collect()] == [400.0, 300.0, 80.0]
    assert [r.value for r in choropleth_legend(table, "marsh_evic_num").collect()] == [2.0]


def test_long_metadata_is_joined_like_any_other(spark, table):
    many = spark.range(12_000).selectExpr(
        "CAST(id AS INT) AS order", "'g' AS var_group", "IF(id = 7, 'occ_units', concat('v', id)) AS var_name",
        "'d' AS display_name", "'num' AS val_fmt",
    )
    assert {r.value_text for r in detail_tables(table, many).collect()} == {"400", "300", "80"}
    assert undescribed_columns(table, many).count() == 11_999


def test_breaks_are_round_and_within_the_domain(spark, table):
    assert [r.value for r in legend_breaks(table, "occ_units").collect()] == [400.0, 300.0, 200.0, 100.0]
    assert [r.value for r in legend_breaks(table, "marsh_evic_num").collect()] == [2.0]
    assert legend_breaks(table, "renter_fam_pov_pct").collect() == []


def test_shapes_reach_the_map(spark, table):
    assert choropleth(table, "occ_units").columns == ["geoid", "value", "pos", "is_missing", "geometry"]
    assert "geometry" not in choropleth(table.drop("geometry"), "occ_units").columns
