"""The area table brought up to date without reading all records again.

Counts of records can be added up, so a store keeps them by area and day. A refresh reads the records of the days that
it is told, works out their sums anew and writes them as one more version of the store; for each day its newest
version counts. Sums replace sums, so a refresh that runs twice, or again after it has failed, changes nothing, and
late, corrected and withdrawn records are all the same: a day is named and read again. Which days that are follows
from the changed records, by :func:`record_days` and :func:`problem_days`.

Records without a date are in no period and so not in the store; tables that have no dates at all (evictions and
regulated stock) are kept as one sum per area, which is worked out again on request. The period of the finished table
is chosen when the store is read.

The store holds one row per area and day, whatever the number of records. Every version says which days it replaces
and which crosswalk and codes it was counted with; a refresh with others is refused.
"""

from __future__ import annotations

import datetime
import json
import zlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tractloom.operators.counting import (
    complaint_counts,
    eviction_counts,
    in_period,
    loss_columns,
    unit_loss_sums,
    violation_counts,
)
from tractloom.operators.crosswalk import block_areas, block_crosswalk
from tractloom.operators.relate import union_filling
from tractloom.plans.area_table import AreaRules, AreaSources, with_counts
from tractloom.sources.sinks import snapshot_versions, write_snapshot

EVICTIONS, LOST, UNITS = "marsh_evic_num", "units_lost", "units_before"
#: What a version replaces: one day, the sums without a day, or all that was before.
DAY, UNDATED, ALL = "day", "undated", "all"

_ONE_DAY = datetime.timedelta(days=1)


def day_ranges(days: Iterable[datetime.date]) -> list[tuple[datetime.date, datetime.date]]:
    """Days as ranges ``(first, day after the last)``, in order."""
    ranges: list[tuple[datetime.date, datetime.date]] = []
    for day in sorted(set(days)):
        if ranges and ranges[-1][1] == day:
            ranges[-1] = (ranges[-1][0], day + _ONE_DAY)
        else:
            ranges.append((day, day + _ONE_DAY))
    return ranges


def on_days(records: DataFrame, date: str, days: Sequence[datetime.date]) -> DataFrame:
    """Records of these days. Ranges reach the scan, so files and row groups of other days are skipped."""
    wanted = F.lit(False)
    for first, end in day_ranges(days):
        wanted = wanted | ((F.col(date) >= F.lit(first)) & (F.col(date) < F.lit(end)))
    return records.filter(wanted)


def record_days(records: DataFrame, date: str) -> list[datetime.date]:
    """The days that some changed records belong to. A calendar bounds their number."""
    days = records.select(F.to_date(date).alias("day")).filter("day IS NOT NULL").distinct()
    return sorted(r.day for r in days.collect())


def problem_days(problems: DataFrame, complaints: DataFrame) -> list[datetime.date]:
    """The days of the complaints that some changed problems belong to."""
    return record_days(complaints.join(problems.select("complaintid").distinct(), "complaintid", "left_semi"), "receiveddate")


def daily_sums(sources: AreaSources, blocks: DataFrame, rules: AreaRules) -> DataFrame:
    """Counts of complaints' problems and of violations by ``geoid`` and ``day``, of all dated records."""
    complaints = sources.complaints.filter(F.col("receiveddate").isNotNull())
    violations = sources.violations.filter(F.col("inspectiondate").isNotNull())
    counted = [
        complaint_counts(
            complaints, sources.complaint_problems, blocks, rules.complaint_types, since=None, per_day=True
        ),
        violation_counts(violations, blocks, rules.violation_classes, since=None, per_day=True),
    ]
    return _summed(union_filling(counted), "geoid", "day")


def undated_sums(sources: AreaSources, blocks: DataFrame, rules: AreaRules) -> DataFrame:
    """Sums by ``geoid`` of the tables without dates."""
    counted = [
        eviction_counts(sources.evictions, blocks, rules.eviction_kind),
        unit_loss_sums(sources.rentstab_summary, sources.rentstab_v2, blocks),
    ]
    return _summed(union_filling(counted), "geoid")


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in by])


def finished_counts(sums: DataFrame, rules: AreaRules) -> DataFrame:
    """One row of indicators per area from sums of any days, as ``merge_keyed`` of the record tables gives them."""
    total = _summed(sums.select("geoid", *rules.complaint_types, *rules.violation_classes, EVICTIONS, LOST, UNITS), "geoid")
    counts = [*rules.complaint_types, *rules.violation_classes, EVICTIONS]
    return total.select("geoid", *counts, *loss_columns())


# --- the store ---------------------------------------------------------------------------------------------------


def _crosswalk(sources: AreaSources, area_list: DataFrame, rules: AreaRules) -> DataFrame:
    return block_crosswalk(sources.parcels, area_list, rules.borough, rules.state, rules.boroughs)


def _basis(crosswalk: DataFrame, rules: AreaRules) -> Column:
    """What sums depend on beside the records: the crosswalk's rows, in any order, and the codes that are counted."""
    codes = json.dumps([rules.complaint_types, rules.violation_classes, rules.eviction_kind], sort_keys=True)
    rows = crosswalk.agg(
        F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("borocode", "block", "geoid")), F.lit(0)))
    )
    return F.concat(rows.scalar(), F.lit(f":{zlib.crc32(codes.encode())}"))


def _marks(spark: SparkSession, days: Sequence[datetime.date], undated: bool, everything: bool) -> DataFrame:
    rows = [(DAY, day) for day in sorted(set(days))]
    rows += [(UNDATED, None)] if undated else []
    rows += [(ALL, None)] if everything else []
    return spark.createDataFrame(rows, "mark STRING, day DATE")


def _versions(spark: SparkSession, path: str) -> DataFrame:
    whole = [n for n, done in snapshot_versions(spark, path).items() if done]
    if not whole:
        raise FileNotFoundError(f"no store of daily sums in {path}")
    return spark.read.option("basePath", path).option("mergeSchema", "true").parquet(
        *[f"{path}/version={n}" for n in whole]
    )


def build_store(
    sources: AreaSources, area_list: DataFrame, path: str, rules: AreaRules | None = None
) -> int:
    """Count all records into a new version that replaces everything, and return the version's number."""
    rules = rules or AreaRules()
    return _write(sources, area_list, path, rules, (), undated=True, everything=True)


def refresh_store(
    sources: AreaSources,
    area_list: DataFrame,
    path: str,
    days: Sequence[datetime.date],
    undated: bool = False,
    rules: AreaRules | None = None,
) -> int | None:
    """Count the records of some days again, and of the tables without dates if asked to.

    Returns the number of the new version, or None where there is nothing to do. Problems are read as a whole, as they
    have no date, but are dropped in their scan unless their complaint is of these days.
    """
    rules = rules or AreaRules()
    if not days and not undated:
        return None
    blocks = _crosswalk(sources, area_list, rules)
    store = _versions(area_list.sparkSession, path).filter("mark IS NOT NULL")
    now = store.select(_basis(blocks, rules).alias("now"), F.col("basis")).distinct().collect()
    if any(r.now != r.basis for r in now):
        raise ValueError(f"the crosswalk or the codes have changed since {path} was built: build it again")
    return _write(sources, area_list, path, rules, days, undated, everything=False)


def _write(
    sources: AreaSources,
    area_list: DataFrame,
    path: str,
    rules: AreaRules,
    days: Sequence[datetime.date],
    undated: bool,
    everything: bool,
) -> int:
    spark = area_list.sparkSession
    crosswalk = _crosswalk(sources, area_list, rules)
    blocks = block_areas(crosswalk)
    parts = [_marks(spark, days, undated, everything).withColumn("basis", _basis(crosswalk, rules))]
    if everything:
        parts.append(daily_sums(sources, blocks, rules))
    elif days:
        complaints = on_days(sources.complaints, "receiveddate", days)
        violations = on_days(sources.violations, "inspectiondate", days)
        dated = AreaSources(**{**vars(sources), "complaints": complaints, "violations": violations})
        parts.append(daily_sums(dated, blocks, rules))
    if undated:
        parts.append(undated_sums(sources, blocks, rules))
    return write_snapshot(union_filling(parts), path)


def stored_sums(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows that count: for every day those of the newest version that replaced it."""
    rows = _versions(spark, path)
    marks = rows.filter("mark IS NOT NULL")
    newest = F.coalesce(marks.filter(F.col("mark") == ALL).agg(F.max("version")).scalar(), F.lit(0))
    replaced = marks.filter(F.col("mark") != ALL).groupBy(F.col("day").alias("of")).agg(F.max("version").alias("since"))
    sums = rows.filter("mark IS NULL").drop("mark", "basis")
    met = sums.join(replaced, F.col("day").eqNullSafe(F.col("of")), "left")
    valid = (F.col("version") >= newest) & (F.col("version") >= F.coalesce("since", F.lit(0)))
    return met.filter(valid).drop("version", "of", "since")


def compact_store(spark: SparkSession, path: str) -> int:
    """Write the rows that count as one version, so that later reads don't meet the replaced ones."""
    marks = _versions(spark, path).filter("mark IS NOT NULL")
    basis = marks.agg(F.max("basis")).scalar()
    head = _marks(spark, (), undated=True, everything=True).withColumn("basis", basis)
    return write_snapshot(union_filling([head, stored_sums(spark, path)]), path)


def stored_counts(spark: SparkSession, path: str, rules: AreaRules | None = None) -> DataFrame:
    """Indicators per area from the store, for the rules' period."""
    rules = rules or AreaRules()
    if rules.since is None and rules.until is None:
        raise ValueError("a store knows dated records only: state a period")
    sums = stored_sums(spark, path)
    undated = sums.filter(F.col("day").isNull())
    return finished_counts(in_period(sums, "day", rules.since, rules.until).unionByName(undated), rules)


def refreshed_area_indicators(
    sources: AreaSources, area_list: DataFrame, path: str, rules: AreaRules | None = None
) -> DataFrame:
    """The table of ``build_area_indicators``, its record counts taken from the store."""
    rules = rules or AreaRules()
    return with_counts(sources, area_list, rules, stored_counts(area_list.sparkSession, path, rules))
