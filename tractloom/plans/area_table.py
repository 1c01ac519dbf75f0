"""The wide area table: survey ratios, record counts and rates per area."""

from __future__ import annotations

import datetime
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.fixed_values import (
    BOROUGH,
    BOROUGH_COUNTIES,
    COMPLAINT_TYPES,
    RESIDENTIAL,
    SINCE,
    STATE,
    SURVEY_COLUMNS,
    SURVEY_COUNTY,
    SURVEY_VARIABLES,
    VIOLATION_CLASSES,
)
from tractloom.operators.counting import (
    complaint_counts,
    eviction_counts,
    unit_losses,
    violation_counts,
)
from tractloom.operators.crosswalk import block_areas, block_crosswalk, check_boroughs, in_areas
from tractloom.operators.projection import add_rates
from tractloom.operators.relate import merge_keyed
from tractloom.operators.reshape import pivot_survey, plain_estimates, survey_slice


@dataclass(frozen=True)
class AreaSources:
    """The input tables; see ``tractloom.sources.schemas`` for their columns."""

    parcels: DataFrame
    complaints: DataFrame
    complaint_problems: DataFrame
    violations: DataFrame
    evictions: DataFrame
    rentstab_summary: DataFrame
    rentstab_v2: DataFrame
    survey: DataFrame
    shapes: DataFrame | None = None


@dataclass(frozen=True)
class AreaRules:
    """What is counted. ``None`` lifts a restriction."""

    state: str = STATE
    county: str | None = SURVEY_COUNTY
    borough: str | None = BOROUGH
    boroughs: Mapping[str, str] = field(default_factory=lambda: dict(BOROUGH_COUNTIES))
    since: datetime.date | None = SINCE
    until: datetime.date | None = None
    eviction_kind: str | None = RESIDENTIAL
    complaint_types: Mapping[str, str] = field(default_factory=lambda: dict(COMPLAINT_TYPES))
    violation_classes: Mapping[str, str] = field(default_factory=lambda: dict(VIOLATION_CLASSES))
    variables: Mapping[str, str] = field(default_factory=lambda: dict(SURVEY_VARIABLES))

    def __post_init__(self) -> None:
        check_boroughs(self.boroughs)


# The formulas decide results. Share of the finished table -> (counts that are added up, denominator).
SURVEY_SHARES = {
    "rent_burden_30p_pct": (
        "rent_burden_num7 + rent_burden_num8 + rent_burden_num9 + rent_burden_num10",
        "nullif(rent_burden_num1, 0) - rent_burden_num11",
    ),
    "rent_burden_50p_pct": ("rent_burden_num10", "nullif(rent_burden_num1, 0) - rent_burden_num11"),
    "renter_fam_pov_pct": (
        "renter_pov_fam5 + renter_pov_fam9 + renter_pov_fam12",
        "renter_pov_fam5 + renter_pov_fam9 + renter_pov_fam12"
        " + renter_nonpov_fam16 + renter_nonpov_fam20 + renter_nonpov_fam23",
    ),
    "renter_pct": ("occ_renter_units", "occ_units"),
    "unit_occ_rent_child_pct": (
        "renter_child_num18 + renter_child_num22 + renter_child_num25",
        "occ_renter_units",
    ),
    "renter_white_pct": ("renter_white_num", "occ_renter_units"),
    "renter_black_pct": ("renter_black_num", "occ_renter_units"),
    "renter_asian_pct": ("renter_asian_num", "occ_renter_units"),
    "renter_latin_pct": ("renter_latin_num", "occ_renter_units"),
}


def shares(frame: DataFrame, wanted: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``part / whole`` per entry; NULL where the whole is 0 or a term is NULL."""
    return frame.withColumns(
        {
            name: F.expr(f"try_divide(CAST({part} AS DOUBLE), CAST({whole} AS DOUBLE))")
            for name, (part, whole) in wanted.items()
        }
    )


def survey_ratios(estimates: DataFrame) -> DataFrame:
    """The survey columns of the finished table.

    Households whose rent burden was not computed leave the denominator.
    """
    return shares(estimates, SURVEY_SHARES).select("geoid", *SURVEY_COLUMNS)


def record_indicators(sources: AreaSources, blocks: DataFrame, rules: AreaRules) -> list[DataFrame]:
    """The four record tables reduced to areas."""
    period = {"since": rules.since, "until": rules.until}
    return [
        complaint_counts(
            sources.complaints, sources.complaint_problems, blocks, rules.complaint_types, **period
        ),
        violation_counts(sources.violations, blocks, rules.violation_classes, **period),
        eviction_counts(sources.evictions, blocks, rules.eviction_kind),
        unit_losses(sources.rentstab_summary, sources.rentstab_v2, blocks),
    ]


def build_area_indicators(
    sources: AreaSources,
    area_list: DataFrame,
    rules: AreaRules | None = None,
) -> DataFrame:
    """One row per surveyed area in ``area_list`` with all its indicators.

    An area without records of a kind keeps NULL there. Where the sources
    carry shapes, their ``geometry`` column is passed on untouched.
    """
    rules = rules or AreaRules()
    crosswalk = block_crosswalk(
        sources.parcels, area_list, rules.borough, rules.state, rules.boroughs
    )
    counted = merge_keyed(record_indicators(sources, block_areas(crosswalk), rules))
    return with_counts(sources, area_list, rules, counted)


def with_counts(sources: AreaSources, area_list: DataFrame, rules: AreaRules, counted: DataFrame) -> DataFrame:
    """The finished table from the indicators of the record tables, one row per area."""
    surveyed = survey_slice(sources.survey, rules.state, rules.county)
    estimates = plain_estimates(pivot_survey(surveyed, rules.variables, margins=False))
    base = survey_ratios(in_areas(estimates, area_list))
    table = add_rates(base.join(counted, "geoid", "left"), "occ_renter_units")
    if sources.shapes is not None:
        table = table.join(sources.shapes.select("geoid", "geometry"), "geoid", "left")
    return table
