"""Small hand-made tables; the expected results in the tests were worked out by hand."""

from __future__ import annotations

import datetime

from tractloom import AreaSources
from tractloom.fixed_values import SURVEY_VARIABLES
from tractloom.sources import schemas

T1, T2, T3 = "36081054500", "36081054900", "36081063900"


def day(text):
    return datetime.date.fromisoformat(text)


PARCELS = [
    (4, 3001, "0545", "QN"),
    (4, 3001, "0545", "QN"),
    (4, 3002, "0549", "QN"),
    (4, 3003, "0549", "QN"),
    (4, 3003, "0545", "QN"),
    (4, 3004, "0999", "QN"),
    (4, 3004, "0639", "QN"),
    (4, 3005, "9999", "QN"),
    (3, 3001, "0545", "BK"),
    (9, 3007, "0545", "QN"),
    (4, 3006, "053101", "QN"),
]
COMPLAINTS = [
    (1, 4, 3001, day("2019-03-01")),
    (2, 4, 3001, day("2018-12-31")),
    (3, 4, 3002, day("2019-01-01")),
    (4, 4, 3003, day("2020-02-02")),
    (5, 4, 3004, day("2019-05-05")),
    (6, 4, 3005, day("2019-06-06")),
]
PROBLEMS = [
    (10, 1, "EMERGENCY"),
    (11, 1, "EMERGENCY"),
    (12, 1, "NON EMERGENCY"),
    (13, 2, "HAZARDOUS"),
    (14, 3, "HAZARDOUS"),
    (15, 4, "IMMEDIATE EMERGENCY"),
    (16, 6, "EMERGENCY"),
]
VIOLATIONS = [
    (1, 4, 3002, "A", day("2019-02-02")),
    (2, 4, 3002, "C", day("2019-02-03")),
    (3, 4, 3002, "I", day("2019-02-03")),
    (4, 4, 3001, "B", day("2018-01-01")),
]
EVICTIONS = [
    ("4030010001", "RESIDENTIAL"),
    ("4030010002", "COMMERCIAL"),
    ("4030030005", "RESIDENTIAL"),
    ("4030050001", "RESIDENTIAL"),
]
SUMMARY = [
    ("4030020001", 10),
    ("4030020002", 0),
    ("4030020003", 5),
    ("4030040001", 4),
    ("4030040002", 6),
]
LATER = [("4030020001", 4), ("4030020002", 0), ("4030020003", 7), ("4030040001", 4)]

# Area -> survey counts; every other variable is 0.
SURVEY = {
    T1: {
        "occ_units": 400, "pop_num": 1000, "occ_renter_units": 200, "rent_burden_num1": 100,
        "rent_burden_num7": 10, "rent_burden_num8": 20, "rent_burden_num9": 5,
        "rent_burden_num10": 15, "rent_burden_num11": 10,
    },
    T2: {"occ_units": 300, "pop_num": 900, "occ_renter_units": 0},
    T3: {
        "occ_units": 80, "pop_num": 160, "occ_renter_units": 50,
        "rent_burden_num1": 10, "rent_burden_num11": 10,
    },
    "36081099900": {"occ_units": 7, "pop_num": 7, "occ_renter_units": 7},
    "36047054500": {"occ_units": 7, "pop_num": 7, "occ_renter_units": 7},
}


def area_list(spark):
    return spark.createDataFrame([(T1,), (T2,), (T3,)], schemas.AREA_LIST)


def survey(spark):
    rows = [
        (geoid, code, float(counts.get(name, 0)), 1.0)
        for geoid, counts in SURVEY.items()
        for name, code in SURVEY_VARIABLES.items()
    ]
    return spark.createDataFrame(rows, schemas.SURVEY)


def area_sources(spark, shapes=False):
    outlines = [(T1, "POLYGON EMPTY"), (T2, "POLYGON EMPTY")]
    return AreaSources(
        parcels=spark.createDataFrame(PARCELS, schemas.PARCELS),
        complaints=spark.createDataFrame(COMPLAINTS, schemas.COMPLAINTS),
        complaint_problems=spark.createDataFrame(PROBLEMS, schemas.COMPLAINT_PROBLEMS),
        violations=spark.createDataFrame(VIOLATIONS, schemas.VIOLATIONS),
        evictions=spark.createDataFrame(EVICTIONS, schemas.EVICTIONS),
        rentstab_summary=spark.createDataFrame(SUMMARY, schemas.RENTSTAB_SUMMARY),
        rentstab_v2=spark.createDataFrame(LATER, schemas.RENTSTAB_V2),
        survey=survey(spark),
        shapes=spark.createDataFrame(outlines, "geoid STRING, geometry STRING") if shapes else None,
    )


MEMBERS = [
    ("m1", "Ana", None, "1", "a@x.org", "12 Fresh Pond Rd", "11385"),
    ("m2", "Bo", None, None, None, "34 Onderdonk Ave", None),
    ("m3", None, None, None, None, "1 A St", "11385"),
    ("m4", "Cy", None, None, None, None, "11385"),
    ("m5", "Di", None, None, None, "56 Lost Ln", "11385"),
    ("m6", "Ed", None, None, None, "78 Lost Ln", "11385"),
    ("m7", "Fi", None, None, None, "90 Nowhere Pl", "11385"),
    ("m8", "Gu", None, None, None, "11 Lost Ln", "11385"),
    ("m9", "Hy", None, None, None, None, None),
]
OVERRIDES = [
    (1, "m5", 40.70, -73.90),
    (2, "m6", None, None),
    (3, "m8", 40.71, -73.91),
    (4, "m8", 40.99, -73.99),
    (5, "m9", 40.72, -73.92),
]
REFERENCE = [
    ("12 Fresh Pond Rd, 11385", "12", "FRESH POND ROAD", "11385", 40.705, -73.895),
    ("34 Onderdonk Ave, QN, queens", "34", "ONDERDONK AVENUE", "11385", 40.706, -73.905),
]


def member_tables(spark):
    return (
        spark.createDataFrame(MEMBERS, schemas.MEMBERS),
        spark.createDataFrame(OVERRIDES, "line INT, uid STRING, latitude DOUBLE, longitude DOUBLE"),
        spark.createDataFrame(REFERENCE, schemas.ADDRESS_REFERENCE),
    )
