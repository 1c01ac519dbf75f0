"""The driver's test tables seen as the record tables of an area analysis.

Only projections, and joins with the 25-row nation table: a view adds no
shuffle of its own to the query that reads it, except where it says so.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from tractloom.fixed_values import STATE, SURVEY_VARIABLES
from tractloom.operators.reshape import unpivot_keeping_nulls
from tractloom.plans.area_table import AreaRules, AreaSources
from tractloom.plans.members import shape_members

SINCE = datetime.date(2000, 1, 1)

# Purchases stand for residential evictions; the proxy area spans all boroughs.
RULES = AreaRules(county=None, borough=None, since=SINCE, eviction_kind="purchase")

# Three keys in a row share a block number, so blocks straddle areas at every size. Numbers start
# over at a prime just below the 100,000 that a block key can hold.
BLOCK_KEYS, BLOCKS = 3, 99_991


def block_of(key: str) -> str:
    return f"({key} div {BLOCK_KEYS}) % {BLOCKS}"


# Only the columns that some view uses; stating them saves a job per file.
TABLES = {
    "nation": "n_nationkey INT, n_regionkey INT",
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE,"
        " l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
    ),
    "events": "event_id BIGINT, user_id BIGINT, event_type STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as tracts: every region is a borough; some tracts have a suffix."""
    tracts = table(spark, folder, "nation").selectExpr(
        "n_nationkey",
        "n_regionkey + 1 AS borocode",
        "element_at(array('MN', 'BX', 'BK', 'QN', 'SI'), n_regionkey + 1) AS borough",
        "element_at(array('061', '005', '047', '081', '085'), n_regionkey + 1) AS county",
        "concat(lpad(n_nationkey, 4, '0'), IF(n_nationkey >= 20, '01', '')) AS tract2010",
    )
    return tracts.selectExpr("*", f"concat('{STATE}', county, rpad(tract2010, 6, '0')) AS geoid")


def area_list(spark: SparkSession, folder: str) -> DataFrame:
    return areas(spark, folder).where("n_nationkey < 15 OR n_nationkey >= 22").select("geoid")


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """One parcel per customer; neighbours share a block number, so blocks straddle tracts."""
    customers = table(spark, folder, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return customers.join(areas(spark, folder), "n_nationkey").selectExpr(
        "borocode", f"CAST({block_of('c_custkey')} AS INT) AS block", "tract2010", "borough"
    )


def complaints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS complaintid",
        "CAST(o_custkey % 5 + 1 AS INT) AS boroughid",
        f"CAST({block_of('o_custkey')} AS INT) AS block",
        "o_orderdate AS receiveddate",
    )


def complaint_problems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS complaintid",
        """CASE concat(l_returnflag, l_linestatus)
             WHEN 'NF' THEN 'NON EMERGENCY' WHEN 'AF' THEN 'EMERGENCY'
             WHEN 'AO' THEN 'IMMEDIATE EMERGENCY' WHEN 'RF' THEN 'HAZARDOUS'
             WHEN 'RO' THEN 'REFERRED' END AS type""",
    )


def violations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "CAST(l_partkey % 5 + 1 AS INT) AS boroid",
        f"CAST({block_of('l_partkey')} AS INT) AS block",
        "translate(l_returnflag, 'ANR', 'ABC') AS class",
        "l_shipdate AS inspectiondate",
    )


def _lot(key: str, rest: str) -> str:
    return f"concat({key} % 5 + 1, lpad({block_of(key)}, 5, '0'), lpad({rest}, 12, '0'))"


def evictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        f"{_lot('user_id', 'event_id')} AS bbl", "event_type AS residentialcommercialind"
    )


def rentstab_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        f"{_lot('p_partkey', 'p_partkey')} AS ucbbl", "p_size - 1 AS unitsstab2007"
    )


def rentstab_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Units left per part, none for every seventh part. Aggregates the line items."""
    kept = table(spark, folder, "lineitem").where("l_partkey % 7 <> 0")
    left = kept.groupBy("l_partkey").min("l_quantity").toDF("l_partkey", "quantity")
    return left.selectExpr(
        f"{_lot('l_partkey', 'l_partkey')} AS ucbbl", "CAST(quantity AS INT) AS uc2018"
    )


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Survey cells in long form: cell ``n`` counts the customers whose key ``n`` divides."""
    codes = list(SURVEY_VARIABLES.values())
    divisible = [f"IF(c_custkey % {n} = 0, 1D, 0D) AS {code}" for n, code in enumerate(codes, start=1)]
    counts = table(spark, folder, "customer").selectExpr("c_nationkey AS n_nationkey", *divisible)
    by_nation = counts.groupBy("n_nationkey").sum(*codes).toDF("n_nationkey", *codes)
    located = by_nation.join(areas(spark, folder), "n_nationkey").select("geoid", *codes)
    return unpivot_keeping_nulls(located).selectExpr(
        "geoid", "name AS variable", "value AS estimate", "value / 10 AS moe"
    )


def area_sources(spark: SparkSession, folder: str) -> AreaSources:
    return AreaSources(
        parcels=parcels(spark, folder),
        complaints=complaints(spark, folder),
        complaint_problems=complaint_problems(spark, folder),
        violations=violations(spark, folder),
        evictions=evictions(spark, folder),
        rentstab_summary=rentstab_summary(spark, folder),
        rentstab_v2=rentstab_v2(spark, folder),
        survey=survey(spark, folder),
    )


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """House, street and postcode of each customer; two keys in a row share a house number."""
    return table(spark, folder, "customer").selectExpr(
        "*",
        "c_custkey div 2 AS house",
        "IF(c_custkey % 11 <> 3, concat(c_custkey div 2, ' ', c_mktsegment, ' ST'), NULL) AS street_line",
        "IF(c_custkey % 7 <> 2, CAST(c_nationkey + 11000 AS STRING), NULL) AS postcode",
    )


def member_records(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as raw member records, some without name, street or postcode."""
    return _places(spark, folder).selectExpr(
        "CAST(c_custkey AS STRING) AS id",
        "IF(c_custkey % 13 <> 5, c_name, NULL) AS Name",
        "IF(c_custkey % 2 = 0, 'they/them', NULL) AS Pronouns",
        "lpad(c_custkey, 10, '0') AS `Phone Number`",
        "IF(c_custkey % 3 <> 0, concat('member', c_custkey, '@example.org'), NULL) AS `E-Mail`",
        "street_line AS Address",
        "postcode AS `Zip code`",
    )


def members(spark: SparkSession, folder: str) -> DataFrame:
    return shape_members(member_records(spark, folder))


def address_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Known addresses: a third as written, a third only with the borough appended, some twice and differently."""
    known = _places(spark, folder).where("street_line IS NOT NULL AND house % 3 <> 2").selectExpr(
        "*", "explode(IF(c_custkey % 5 = 1, array(0, 1), array(0))) AS copy"
    )
    return known.selectExpr(
        "concat(street_line, ', ', coalesce(postcode, 'QN'), IF(house % 3 = 0, '', ', queens')) AS q",
        "IF(house % 17 <> 4, CAST(house + copy AS STRING), NULL) AS house_number",
        "concat(c_mktsegment, '-SIDE STREET') AS street",
        "coalesce(postcode, '11385') AS zip",
        "IF(house % 19 <> 7, CAST(house AS DOUBLE) / 10000 + 40 - copy, NULL) AS latitude",
        "CAST(house AS DOUBLE) / 10000 - 74 + copy AS longitude",
    )


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-made coordinates for every tenth member, half of them blank, some twice."""
    lines = table(spark, folder, "customer").where("c_custkey % 10 = 0").selectExpr(
        "c_custkey", "c_acctbal", "explode(IF(c_custkey % 30 = 0, array(0, 1), array(0))) AS copy"
    )
    filled = "c_custkey % 20 <> 0 OR copy = 1"
    return lines.selectExpr(
        "c_custkey * 2 + copy AS line",
        "CAST(c_custkey AS STRING) AS uid",
        f"IF({filled}, c_acctbal + copy, NULL) AS latitude",
        f"IF({filled}, c_acctbal - copy, NULL) AS longitude",
    )


def menu_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as indicator metadata; size 1 and 2 play the two kinds of totals group."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS order",
        """CASE p_size WHEN 1 THEN 'Totals' WHEN 2 THEN 'Totals (2014-18)'
             ELSE concat(p_type, ' (a) and ', p_brand, ' (b)') END AS var_group""",
        "concat('v', p_partkey) AS var_name",
        "p_name AS display_name",
        "'num' AS val_fmt",
    )
