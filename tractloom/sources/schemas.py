"""Columns of the input tables; nothing is ever inferred."""

from __future__ import annotations

from tractloom.fixed_values import RAW_MEMBER_COLUMNS

AREA_LIST = "geoid STRING"

PARCELS = "borocode INT, block INT, tract2010 STRING, borough STRING"
COMPLAINTS = "complaintid INT, boroughid INT, block INT, receiveddate DATE"
COMPLAINT_PROBLEMS = "problemid INT, complaintid INT, type STRING"
VIOLATIONS = "violationid INT, boroid INT, block INT, class STRING, inspectiondate DATE"
EVICTIONS = "bbl STRING, residentialcommercialind STRING"
RENTSTAB_SUMMARY = "ucbbl STRING, unitsstab2007 INT"
RENTSTAB_V2 = "ucbbl STRING, uc2018 INT"

SURVEY = "geoid STRING, variable STRING, estimate DOUBLE, moe DOUBLE"

SHAPES = "geoid STRING, wkb BINARY"

MEMBERS = ", ".join(f"`{c}` STRING" for c in RAW_MEMBER_COLUMNS)
OVERRIDES = "uid STRING, address STRING, latitude DOUBLE, longitude DOUBLE"
ADDRESS_REFERENCE = (
    "q STRING, house_number STRING, street STRING, zip STRING, latitude DOUBLE, longitude DOUBLE"
)

INDICATOR_META = "`order` INT, var_group STRING, var_name STRING, display_name STRING, val_fmt STRING"
