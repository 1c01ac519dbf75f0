"""Every registered query: the operators applied to the views of the test tables.

All run over whole tables. Each takes a session and a table folder and
returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.functions.text import normalised_address, postal_address
from tractloom.operators import counting, crosswalk, projection, relate, reshape
from tractloom.plans import area_table, map_views, members, refresh
from tractloom.registry import views
from tractloom.sources.readers import standard_indicator_meta

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

DETAIL_AREA = "36061000000"


def query(function: Query) -> Query:
    """Register under the function's name; a trailing underscore only avoids a clash."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    return crosswalk.block_crosswalk(views.parcels(spark, folder), views.area_list(spark, folder))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return crosswalk.block_areas(_crosswalk(spark, folder))


def _estimates(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.plain_estimates(reshape.pivot_survey(views.survey(spark, folder), margins=False))


# Areas and record tables


@query
def area_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return area_table.build_area_indicators(
        views.area_sources(spark, folder), views.area_list(spark, folder), views.RULES
    )


@query
def src_area_list(spark: SparkSession, folder: str) -> DataFrame:
    """Listed areas in which there is a parcel."""
    keyed = crosswalk.keyed_parcels(views.parcels(spark, folder)).select("geoid").distinct()
    return crosswalk.in_areas(keyed, views.area_list(spark, folder))


@query
def geoid_key(spark: SparkSession, folder: str) -> DataFrame:
    return crosswalk.keyed_parcels(views.parcels(spark, folder))


@query
def geoid_key_borough(spark: SparkSession, folder: str) -> DataFrame:
    keyed = crosswalk.keyed_parcels(views.parcels(spark, folder), borough="QN")
    return keyed.groupBy("borocode", "block", "geoid").agg(F.count("*").alias("n_parcels"))


@query
def filter_semi_in_list(spark: SparkSession, folder: str) -> DataFrame:
    keyed = crosswalk.keyed_parcels(views.parcels(spark, folder))
    return crosswalk.in_areas(keyed, views.area_list(spark, folder)).select("borocode", "block", "geoid")


@query
def crosswalk_(spark: SparkSession, folder: str) -> DataFrame:
    return _crosswalk(spark, folder).select("borocode", "block", "geoid")


@query
def ind_complaints(spark: SparkSession, folder: str) -> DataFrame:
    return counting.complaint_counts(
        views.complaints(spark, folder),
        views.complaint_problems(spark, folder),
        _blocks(spark, folder),
        since=views.SINCE,
    )


@query
def ind_violations(spark: SparkSession, folder: str) -> DataFrame:
    return counting.violation_counts(
        views.violations(spark, folder), _blocks(spark, folder), since=views.SINCE
    )


@query
def ind_evictions(spark: SparkSession, folder: str) -> DataFrame:
    return counting.eviction_counts(
        views.evictions(spark, folder), _blocks(spark, folder), views.RULES.eviction_kind
    )


@query
def ind_dereg(spark: SparkSession, folder: str) -> DataFrame:
    return counting.unit_losses(
        views.rentstab_summary(spark, folder), views.rentstab_v2(spark, folder), _blocks(spark, folder)
    )


def _record_indicators(spark: SparkSession, folder: str) -> list[DataFrame]:
    sources = views.area_sources(spark, folder)
    return area_table.record_indicators(sources, _blocks(spark, folder), views.RULES)


@query
def full_join_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return relate.full_join_on(_record_indicators(spark, folder))


@query
def merged_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return relate.merge_keyed(_record_indicators(spark, folder))


@query
def daily_sums(spark: SparkSession, folder: str) -> DataFrame:
    """What a store keeps: counts by area and day, of all days."""
    return refresh.daily_sums(views.area_sources(spark, folder), _blocks(spark, folder), views.RULES)


@query
def summed_indicators(spark: SparkSession, folder: str) -> DataFrame:
    """The indicators of a period added up from daily and undated sums."""
    sources, blocks = views.area_sources(spark, folder), _blocks(spark, folder)
    daily = counting.in_period(refresh.daily_sums(sources, blocks, views.RULES), "day", views.SINCE)
    undated = refresh.undated_sums(sources, blocks, views.RULES)
    return refresh.finished_counts(relate.union_filling([daily, undated]), views.RULES)


@query
def join_left_fanout(spark: SparkSession, folder: str) -> DataFrame:
    return relate.fanout_counts(
        views.complaints(spark, folder),
        views.complaint_problems(spark, folder),
        "complaintid",
        "boroughid",
        "type",
    )


@query
def join_prefix_key(spark: SparkSession, folder: str) -> DataFrame:
    return counting.located_evictions(views.evictions(spark, folder), _blocks(spark, folder), None)


# Survey and projections


@query
def pivot_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.pivot_survey(views.survey(spark, folder))


@query
def proj_rename_pattern(spark: SparkSession, folder: str) -> DataFrame:
    wide = reshape.pivot_survey(views.survey(spark, folder)).withColumnRenamed("geoid", "GEOID")
    return reshape.plain_estimates(wide.withColumn("NAME", F.col("GEOID")))


@query
def acs_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return area_table.survey_ratios(_estimates(spark, folder))


@query
def rate_across(spark: SparkSession, folder: str) -> DataFrame:
    counted = full_join_indicators(spark, folder)
    renters = _estimates(spark, folder).select("geoid", "occ_renter_units")
    return projection.add_rates(renters.join(counted, "geoid", "left"), "occ_renter_units")


@query
def unpivot_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return reshape.unpivot_keeping_nulls(area_indicators(spark, folder))


# Members


def _cascade(spark: SparkSession, folder: str) -> members.Cascade:
    return members.resolve_cascade(
        views.members(spark, folder),
        views.overrides(spark, folder),
        views.address_reference(spark, folder),
    )


def _pending(spark: SparkSession, folder: str) -> DataFrame:
    """Members with an address and without an override."""
    addressed = views.members(spark, folder).filter(F.col("address").isNotNull())
    return relate.anti_chain(addressed, [views.overrides(spark, folder)])


@query
def manual_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of each customer."""
    orders = views.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("line"), "o_orderdate", "o_totalprice"
    )
    return relate.first_per_key(orders, "uid", "line")


@query
def manual_overrides(spark: SparkSession, folder: str) -> DataFrame:
    return members.first_overrides(views.overrides(spark, folder))


@query
def anti_join_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Members that neither an override nor the first attempt places."""
    addressed = views.members(spark, folder).filter(F.col("address").isNotNull())
    placed = members.geocode_pass(addressed, views.address_reference(spark, folder))
    return relate.anti_chain(addressed, [views.overrides(spark, folder), placed]).select("uid", "address")


@query
def address_clean(spark: SparkSession, folder: str) -> DataFrame:
    reference = views.address_reference(spark, folder)
    clean = normalised_address(F.col("house_number"), F.col("street"), F.col("zip"))
    return reference.select("q", F.coalesce(clean, "q").alias("address"), clean.alias("clean_address"))


@query
def address_parts(spark: SparkSession, folder: str) -> DataFrame:
    records = views.member_records(spark, folder)
    return records.select(
        F.col("id").alias("uid"), postal_address(F.col("Address"), F.col("`Zip code`")).alias("address")
    )


@query
def geocode_pass(spark: SparkSession, folder: str) -> DataFrame:
    found = members.geocode_pass(_pending(spark, folder), views.address_reference(spark, folder))
    return found.select("uid", "address", "clean_address", "latitude", "longitude")


@query
def union_by_name_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Overridden members, which have no clean address, stacked on those that the first attempt places."""
    columns = ["uid", "address", "latitude", "longitude"]
    fixed = members.first_overrides(views.overrides(spark, folder))
    overridden = views.members(spark, folder).join(fixed, "uid")
    found = members.geocode_pass(_pending(spark, folder), views.address_reference(spark, folder))
    return relate.union_filling([overridden.select(*columns), found.select(*columns, "clean_address")])


@query
def geocode_members(spark: SparkSession, folder: str) -> DataFrame:
    return _cascade(spark, folder).resolved


@query
def geocode_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _cascade(spark, folder).outcomes()


@query
def unresolved_worklist(spark: SparkSession, folder: str) -> DataFrame:
    return members.work_sheet(_cascade(spark, folder).work_list)


@query
def fill_strings(spark: SparkSession, folder: str) -> DataFrame:
    everyone = views.members(spark, folder)
    return projection.fill_text(everyone.withColumn("number", F.nullif(F.length("uid"), F.lit(3))))


@query
def member_points(spark: SparkSession, folder: str) -> DataFrame:
    points = members.member_points(_cascade(spark, folder).resolved)
    return points.select("uid", "name", "address", "point.x", "point.y")


# Map views


@query
def variable_menu(spark: SparkSession, folder: str) -> DataFrame:
    return map_views.variable_menu(views.menu_meta(spark, folder))


@query
def choropleth_scale(spark: SparkSession, folder: str) -> DataFrame:
    return map_views.choropleth(area_indicators(spark, folder), "marsh_evic_num")


@query
def choropleth_reversed(spark: SparkSession, folder: str) -> DataFrame:
    return map_views.choropleth(area_indicators(spark, folder), "marsh_evic_num", reverse=True)


@query
def choropleth_layers(spark: SparkSession, folder: str) -> DataFrame:
    return map_views.choropleth_layers(area_indicators(spark, folder))


@query
def choropleth_legend(spark: SparkSession, folder: str) -> DataFrame:
    return map_views.choropleth_legend(area_indicators(spark, folder), "marsh_evic_num")


@query
def legend_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return map_views.legend_breaks(area_indicators(spark, folder), "marsh_evic_num")


@query
def undescribed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of parts and of indicators against the area table: the parts' names are no columns."""
    table = area_indicators(spark, folder)
    meta = standard_indicator_meta(spark).unionByName(
        views.menu_meta(spark, folder).withColumn("order", F.col("order").cast("int"))
    )
    return map_views.undescribed_columns(table, meta)


@query
def detail_table(spark: SparkSession, folder: str) -> DataFrame:
    """The detail table of every area."""
    table = area_indicators(spark, folder)
    return map_views.detail_tables(table, standard_indicator_meta(spark))


@query
def detail_table_area(spark: SparkSession, folder: str) -> DataFrame:
    """The detail table of one area, as asked for by a click on the map."""
    table = area_indicators(spark, folder)
    return map_views.detail_table(table, standard_indicator_meta(spark), DETAIL_AREA)
