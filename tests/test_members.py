import fixtures as fx
import pytest
from pyspark.sql import functions as F

from tractloom import UnresolvedAddresses, member_points, require_resolved, resolve_cascade, shape_members
from tractloom.functions.text import menu_label, title_case
from tractloom.operators import projection, relate
from tractloom.plans import members as mod
from tractloom.sources import readers, schemas


@pytest.fixture(scope="module")
def cascade(spark):
    records, overrides, reference = fx.member_tables(spark)
    return resolve_cascade(shape_members(records), overrides, reference)


def test_resolved(cascade):
    rows = {r.uid: (r.address, r.latitude, r.longitude) for r in cascade.resolved.collect()}
    assert rows == {
        "m1": ("12 Fresh Pond Road, 11385", 40.705, -73.895),
        "m2": ("34 Onderdonk Avenue, 11385", 40.706, -73.905),
        "m5": ("56 Lost Ln, 11385", 40.70, -73.90),
        "m8": ("11 Lost Ln, 11385", 40.71, -73.91),
        "m9": ("-", 40.72, -73.92),
    }


def test_work_list(cascade):
    assert [tuple(r) for r in cascade.work_list.collect()] == [("m7", "90 Nowhere Pl, 11385")]


def test_outcomes(cascade):
    outcomes = {r.uid: r.outcome for r in cascade.placed.collect()}
    assert outcomes == {
        "m1": "attempt 1", "m2": "attempt 2", "m4": "no address", "m5": "override",
        "m6": "blank override", "m7": "unresolved", "m8": "override", "m9": "override",
    }


def test_missing_text_is_filled(cascade):
    row = cascade.resolved.filter("uid = 'm1'").first()
    assert (row.pronouns, row.phone, row.email) == ("-", "1", "a@x.org")


def test_points(cascade):
    points = member_points(cascade.resolved)
    assert points.columns == ["uid", "name", "pronouns", "phone", "email", "address", "point"]
    assert points.filter("uid = 'm1'").first().point.asDict() == {"x": -73.895, "y": 40.705}


def test_gate_appends_and_stops(spark, cascade, tmp_path):
    path = str(tmp_path / "overrides")
    with pytest.raises(UnresolvedAddresses) as caught:
        require_resolved(cascade.work_list, path)
    assert caught.value.count == 1
    blank = readers.read_overrides(spark, path)
    assert [(r.uid, r.latitude, r.longitude) for r in blank.collect()] == [("m7", None, None)]
    # With its blank line on file the member is no longer asked for.
    records, _, reference = fx.member_tables(spark)
    again = resolve_cascade(shape_members(records), blank, reference)
    assert "m7" not in {r.uid for r in again.work_list.collect()}
    assert again.placed.filter("uid = 'm7'").first().outcome == "blank override"


def test_gate_passes_and_writes_nothing(spark, cascade, tmp_path):
    path = tmp_path / "overrides"
    require_resolved(cascade.work_list.filter("false"), str(path))
    assert not path.exists()


def test_missing_override_file_is_empty(spark, tmp_path):
    nothing = readers.read_overrides(spark, str(tmp_path / "absent.csv"))
    assert nothing.collect() == []
    records, _, reference = fx.member_tables(spark)
    placed = resolve_cascade(shape_members(records), nothing, reference).placed
    assert placed.filter("outcome like '%override'").count() == 0


def test_first_line_of_a_file_wins(spark, tmp_path):
    path = tmp_path / "manual.csv"
    lines = [f"u{i % 300},skipped,{i},{-i}" for i in range(3000)]
    path.write_text("uid,address,latitude,longitude\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        overrides = readers.read_overrides(spark, str(path))
        assert overrides.rdd.getNumPartitions() > 3
        first = mod.first_overrides(overrides)
        found = {r.uid: (r.latitude, r.longitude) for r in first.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {f"u{i}": (float(i), float(-i)) for i in range(300)}


def test_earlier_attempt_and_duplicate_entries(spark):
    """One answer per address, whatever the reference repeats."""
    reference = spark.createDataFrame(
        [
            ("1 A St, 1", "1", "A STREET", "1", 2.0, 3.0),
            ("1 A St, 1", "1", "A STREET", "1", 1.0, 3.0),
            ("1 A St, 1, queens", "1", "A STREET", "1", 0.0, 0.0),
            ("2 B St, 1", "2", "B STREET", "1", None, None),
            ("2 B St, 1, queens", "2", None, "1", 5.0, 6.0),
        ],
        schemas.ADDRESS_REFERENCE,
    )
    people = spark.createDataFrame(
        [(str(i), "n", "1 A St", "1") for i in range(40)] + [("b", "n", "2 B St", "1")],
        "id STRING, Name STRING, Address STRING, `Zip code` STRING",
    )
    for column in ("Pronouns", "Phone Number", "E-Mail"):
        people = people.withColumn(column, F.lit(None).cast("string"))
    _, overrides, _ = fx.member_tables(spark)
    rows = resolve_cascade(shape_members(people), overrides, reference).resolved.collect()
    assert len(rows) == 41
    assert {(r.address, r.latitude) for r in rows} == {("1 A Street, 1", 1.0), ("2 B St, 1", 5.0)}


def test_single_pass_matches_cascade(spark, cascade):
    records, overrides, reference = fx.member_tables(spark)
    everyone = shape_members(records)
    pending = relate.anti_chain(everyone, [everyone.filter("address is null"), overrides])
    assert {r.uid for r in pending.collect()} == {"m1", "m2", "m7"}
    first = mod.geocode_pass(pending, reference)
    second = mod.geocode_pass(relate.anti_chain(pending, [first]), reference, ", queens")
    assert [r.uid for r in first.collect()] == ["m1"]
    assert [r.uid for r in second.collect()] == ["m2"]
    left = relate.anti_chain(pending, [first, second]).select("uid", "address")
    assert left.collect() == cascade.work_list.collect()


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("MARTIN-LUTHER KING BLVD", "Martin-Luther King Blvd"),
        ("12TH ST/AVE", "12th St/Ave"),
        ("O'NEIL PLACE", "O'neil Place"),
        ("", ""),
        (None, None),
    ],
)
def test_title_case(spark, text, wanted):
    frame = spark.createDataFrame([(text,)], "s STRING")
    assert frame.select(title_case(F.col("s"))).first()[0] == wanted


def test_menu_label(spark):
    frame = spark.createDataFrame([("A (x) B (y)", "n")], "g STRING, d STRING")
    assert frame.select(menu_label(F.col("g"), F.col("d"))).first()[0] == "A B: n"


def test_fill_text_leaves_other_types(spark):
    frame = spark.createDataFrame([(None, None)], "s STRING, n INT")
    assert tuple(projection.fill_text(frame).first()) == ("-", None)


def test_first_per_key_keeps_blank_values(spark):
    frame = spark.createDataFrame([("a", 2, 5.0), ("a", 1, None), ("b", 7, 1.0)], "k STRING, line INT, v DOUBLE")
    rows = relate.first_per_key(frame, "k", "line").collect()
    assert {r.k: (r.line, r.v) for r in rows} == {"a": (1, None), "b": (7, 1.0)}
