"""Parcels keyed to areas, and the block-to-area crosswalk."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractloom.fixed_values import BOROUGH_COUNTIES, STATE, TRACT_WIDTH
from tractloom.functions.keys import BLOCK_SPAN, area_id, block_key, padded_block


def keyed_parcels(
    parcels: DataFrame,
    borough: str | None = None,
    state: str = STATE,
    boroughs: Mapping[str, str] = BOROUGH_COUNTIES,
) -> DataFrame:
    """Text keys ``borocode``, ``block`` and ``geoid`` of each parcel."""
    if borough is not None:
        parcels = parcels.filter(F.col("borough") == borough)
    number = F.col("borocode").cast("string")
    return parcels.select(
        number.alias("borocode"),
        padded_block(F.col("block")).alias("block"),
        area_id(state, boroughs, number, F.col("tract2010")).alias("geoid"),
    )


def in_areas(frame: DataFrame, area_list: DataFrame, key: str = "geoid") -> DataFrame:
    """Keep rows whose area is listed.

    The list carries no broadcast hint: Spark broadcasts it when its measured
    size allows and shuffles it otherwise.
    """
    return frame.join(area_list.select(key), key, "left_semi")


def _tract_number(tract: Column) -> Column:
    """The padded tract as a whole number in the order of its text: its bytes, six of them.

    Tract codes are plain ASCII; any other text gives NULL and matches nothing.
    """
    padded = F.rpad(tract, TRACT_WIDTH, "0")
    return F.when(F.octet_length(padded) == TRACT_WIDTH, F.conv(F.hex(padded), 16, 10).cast("bigint"))


def _listed_tracts(area_list: DataFrame, state: str, boroughs: Mapping[str, str]) -> DataFrame:
    """The listed areas of each borough as numbers."""
    county_at = len(state) + 1
    counties = F.array(*[F.struct(F.lit(int(b)).alias("digit"), F.lit(c).alias("county")) for b, c in boroughs.items()])
    own = area_list.filter(F.col("geoid").startswith(state)).select("geoid", F.explode(counties).alias("b"))
    fits = F.col("geoid").substr(F.lit(county_at), F.length("b.county")) == F.col("b.county")
    tract = F.col("geoid").substr(F.lit(county_at) + F.length("b.county"), F.length("geoid"))
    whole = own.filter(fits & (F.length(tract) == TRACT_WIDTH))
    return whole.select(F.col("b.digit").alias("digit"), _tract_number(tract).alias("tract"))


def check_boroughs(boroughs: Mapping[str, str]) -> None:
    """Refuse borough codes that are no single digit: they can't form a block key."""
    wrong = sorted(b for b in boroughs if len(b) != 1 or b not in "123456789")
    if wrong:
        raise ValueError(f"borough codes must be one digit from 1 to 9, not {wrong}")


def block_crosswalk(
    parcels: DataFrame,
    area_list: DataFrame,
    borough: str | None = None,
    state: str = STATE,
    boroughs: Mapping[str, str] = BOROUGH_COUNTIES,
) -> DataFrame:
    """One area per borough and block: the smallest listed area it touches.

    Areas outside the list are removed before choosing, so a block on the edge
    of the list falls inside it. Within a borough areas differ by their tract
    alone, so parcels are folded as two whole numbers in one hash aggregation,
    on the map side first: a block or area with very many parcels costs no more
    than others. Text is made for the blocks of the result only.
    """
    check_boroughs(boroughs)
    if borough is not None:
        parcels = parcels.filter(F.col("borough") == borough)
    numbered = parcels.select(
        F.col("borocode").try_cast("int").alias("digit"),
        block_key(F.col("borocode"), F.col("block")).alias("key"),
        _tract_number(F.col("tract2010")).alias("tract"),
    ).filter(F.col("key").isNotNull() & F.col("tract").isNotNull())
    listed = numbered.join(_listed_tracts(area_list, state, boroughs), ["digit", "tract"], "left_semi")
    smallest = listed.groupBy("key").agg(F.min("tract").alias("tract"))
    digit = F.floor(F.col("key") / BLOCK_SPAN).cast("string")
    tract = F.decode(F.unhex(F.hex("tract")), "UTF-8")
    return smallest.select(
        digit.alias("borocode"),
        padded_block(F.col("key") % BLOCK_SPAN).alias("block"),
        area_id(state, boroughs, digit, tract).alias("geoid"),
    )


def block_areas(crosswalk: DataFrame) -> DataFrame:
    """The crosswalk as ``block_id -> geoid``, marked for broadcast.

    There is one row per block key and at most 900,000 block keys, see
    :mod:`tractloom.functions.keys`; an int and an 11-character id per row stay
    within some tens of megabytes whatever the size of the record tables.
    """
    key = block_key(F.col("borocode"), F.col("block"))
    return F.broadcast(crosswalk.select(key.alias("block_id"), "geoid"))


def attach_area(records: DataFrame, blocks: DataFrame, block: Column) -> DataFrame:
    """Add ``geoid`` to each record on a mapped block and drop the others.

    ``blocks`` comes from :func:`block_areas`. Every caller joins on the same
    integer key, so one broadcast serves all record tables of a plan. No area
    is NULL; saying so keeps plans equal where a later join says it.
    """
    located = records.withColumn("block_id", block).join(blocks, "block_id").drop("block_id")
    return located.filter(F.col("geoid").isNotNull())
