"""Record tables reduced to one row of indicators per area.

Each function maps records to areas with the broadcast crosswalk and then
aggregates, so records are dropped before any shuffle and only partial sums
are exchanged: an area holding most of the records is no hot spot.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tractloom.fixed_values import COMPLAINT_TYPES, RESIDENTIAL, SINCE, VIOLATION_CLASSES
from tractloom.functions.keys import block_key, block_key_of_lot
from tractloom.functions.numeric import ratio
from tractloom.operators.crosswalk import attach_area
from tractloom.operators.keyfilter import key_filter, possibly_in


def count_equal(column: str, wanted: Mapping[str, str]) -> list[Column]:
    """A conditional count per entry; NULL, not 0, where no value is known."""
    return [F.sum((F.col(column) == v).cast("int")).alias(name) for name, v in wanted.items()]


def in_period(
    frame: DataFrame,
    column: str,
    since: datetime.date | None,
    until: datetime.date | None = None,
) -> DataFrame:
    """Rows dated ``since <= date < until``; either end may be open."""
    if since is not None:
        frame = frame.filter(F.col(column) >= F.lit(since))
    if until is not None:
        frame = frame.filter(F.col(column) < F.lit(until))
    return frame


def _grouping(per_day: bool, date: str) -> tuple[list[str], list[Column]]:
    """What records are grouped by, and the column needed for it."""
    return (["geoid", "day"], [F.to_date(date).alias("day")]) if per_day else (["geoid"], [])


def complaint_counts(
    complaints: DataFrame,
    problems: DataFrame,
    blocks: DataFrame,
    types: Mapping[str, str] = COMPLAINT_TYPES,
    since: datetime.date | None = SINCE,
    until: datetime.date | None = None,
    per_day: bool = False,
) -> DataFrame:
    """Problems of complaints, counted by type in each area, or on each day of each area.

    Every complaint row counts all its problems; areas whose complaints have
    no problem keep a row of NULLs. Both sides are reduced to their own key
    before they meet: problems to counts per complaint, complaints to a number
    of rows per complaint and area. Neither side can then hold a hot key.
    Problems of other complaints are dropped in their scan by a filter of
    the recent, mapped ones, which is read from the same exchange.
    """
    by, day = _grouping(per_day, "receiveddate")
    located = attach_area(
        in_period(complaints, "receiveddate", since, until).select("complaintid", "boroughid", "block", *day),
        blocks,
        block_key(F.col("boroughid"), F.col("block")),
    )
    occurrences = located.groupBy("complaintid", *by).agg(F.count("*").alias("occurrences"))
    # A problem without a type changes neither a count nor a missing one.
    typed = problems.filter(F.col("type").isNotNull()).select("complaintid", "type")
    # Naming the count keeps this branch equal to the other one, whose exchange it then reuses.
    typed = possibly_in(typed, "complaintid", key_filter(occurrences.filter("occurrences > 0"), "complaintid"))
    counts = typed.groupBy("complaintid").agg(*count_equal("type", types))
    return (
        occurrences.join(counts, "complaintid", "left")
        .groupBy(*by)
        .agg(*[F.sum(F.col("occurrences") * F.col(name)).alias(name) for name in types])
    )


def violation_counts(
    violations: DataFrame,
    blocks: DataFrame,
    classes: Mapping[str, str] = VIOLATION_CLASSES,
    since: datetime.date | None = SINCE,
    until: datetime.date | None = None,
    per_day: bool = False,
) -> DataFrame:
    """Violations, counted by class in each area, or on each day of each area."""
    by, day = _grouping(per_day, "inspectiondate")
    recent = in_period(violations, "inspectiondate", since, until).select("boroid", "block", "class", *day)
    located = attach_area(recent, blocks, block_key(F.col("boroid"), F.col("block")))
    return located.groupBy(*by).agg(*count_equal("class", classes))


def located_evictions(evictions: DataFrame, blocks: DataFrame, kind: str | None = RESIDENTIAL) -> DataFrame:
    """Evictions with the area of the block their lot number starts with."""
    if kind is not None:
        evictions = evictions.filter(F.col("residentialcommercialind") == kind)
    return attach_area(evictions, blocks, block_key_of_lot(F.col("bbl")))


def eviction_counts(evictions: DataFrame, blocks: DataFrame, kind: str | None = RESIDENTIAL) -> DataFrame:
    located = located_evictions(evictions, blocks, kind)
    return located.groupBy("geoid").agg(F.count("*").alias("marsh_evic_num"))


def unit_loss_sums(before: DataFrame, after: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regulated units lost, and the units there were: ``units_lost`` and ``units_before`` of each area.

    Only buildings that had units and gained none count; a building missing
    from ``after`` is in neither the difference nor the total. Should an id
    repeat, every row of one table meets every row of the other. No pairs are
    made for that: rows of both tables are stacked and counted by value, and
    running sums over a building's values, in order, say how many later rows
    have at most so many units, and how many units these have. Equal ids start
    with the same block, so rows of ``after`` on unmapped blocks are dropped
    before they move, as are those without a number of units, which can't be
    compared.
    """
    housed = before.filter(F.col("unitsstab2007") > 0).select("ucbbl", F.col("unitsstab2007").alias("units"))
    later = after.filter(F.col("uc2018").isNotNull()).select("ucbbl", F.col("uc2018").alias("units"))
    sides = [
        attach_area(rows, blocks, block_key_of_lot(F.col("ucbbl"))).select(
            "ucbbl", "geoid", F.col("units").cast("long").alias("units"), F.lit(b).alias("b"), F.lit(a).alias("a")
        )
        for rows, b, a in ((housed, 1, 0), (later, 0, 1))
    ]
    values = (
        sides[0].unionByName(sides[1]).groupBy("ucbbl", "geoid", "units").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    )
    upto = W.partitionBy("ucbbl", "geoid").orderBy("units").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = values.withColumns(
        {"pairs": F.sum("a").over(upto), "kept": F.sum(F.col("a") * F.col("units")).over(upto)}
    ).filter("b > 0 AND pairs > 0")
    lost = F.sum(F.col("b") * (F.col("pairs") * F.col("units") - F.col("kept")))
    return summed.groupBy("geoid").agg(
        lost.alias("units_lost"), F.sum(F.col("b") * F.col("pairs") * F.col("units")).alias("units_before")
    )


def loss_columns() -> list[Column]:
    """The finished columns of :func:`unit_loss_sums`."""
    lost, units = F.col("units_lost"), F.col("units_before")
    return [lost.cast("double").alias("dereg_units"), ratio(lost, units).alias("dereg_pct")]


def unit_losses(before: DataFrame, after: DataFrame, blocks: DataFrame) -> DataFrame:
    """Regulated units lost, and their share of the units there were."""
    return unit_loss_sums(before, after, blocks).select("geoid", *loss_columns())
