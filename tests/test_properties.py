"""Properties that hold for any input, tried on generated tables and on the test tables."""

from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tractloom.operators import counting, crosswalk, relate
from tractloom.registry import views
from tractloom.registry.queries import QUERIES
from tractloom.sources import schemas

FEW = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
maybe_type = st.sampled_from(["A", "B", None])


@FEW
@given(
    st.lists(st.tuples(st.integers(0, 4), st.sampled_from([10, 11, None])), max_size=12),
    st.lists(st.tuples(st.integers(0, 4), maybe_type), max_size=12),
)
def test_complaints_equal_the_joined_rows(spark, complaints, problems):
    """Brute force: join row by row, then count."""
    blocks = spark.createDataFrame([(400010, "x"), (400011, "y")], "block_id INT, geoid STRING")
    facts = spark.createDataFrame(
        [(c, 4, b, None) for c, b in complaints], schemas.COMPLAINTS
    )
    details = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(problems)], schemas.COMPLAINT_PROBLEMS)
    rows = counting.complaint_counts(facts, details, blocks, {"a": "A", "b": "B"}, since=None).collect()
    wanted = {}
    for c, b in complaints:
        if b is None:
            continue
        tally = wanted.setdefault({10: "x", 11: "y"}[b], [None, None])
        for other, t in problems:
            if other == c and t is not None:
                wanted[{10: "x", 11: "y"}[b]] = tally = [(tally[0] or 0) + (t == "A"), (tally[1] or 0) + (t == "B")]
    assert {r.geoid: [r.a, r.b] for r in rows} == wanted


@FEW
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=12),
    st.lists(st.tuples(st.integers(0, 3), maybe_type), max_size=12),
)
def test_fanout_counts_equal_the_joined_rows(spark, left, right):
    a = spark.createDataFrame(left, "k INT, g INT")
    b = spark.createDataFrame(right, "k INT, t STRING")
    rows = relate.fanout_counts(a, b, "k", "g", "t").collect()
    by_key = defaultdict(list)
    for k, t in right:
        by_key[k].append(t)
    wanted = Counter((g, t) for k, g in left for t in (by_key[k] or [None]))
    assert {(r.g, r.t): r.n_rows for r in rows} == wanted


@FEW
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=10),
    st.lists(st.tuples(st.integers(0, 2), st.sampled_from([0, 1, 2, 3, None])), max_size=10),
)
def test_unit_losses_equal_the_joined_rows(spark, before, after):
    blocks = spark.createDataFrame([(400010, "x"), (400011, "y")], "block_id INT, geoid STRING")
    lots = {0: "4000100001", 1: "4000100002", 2: "4000110001"}
    old = spark.createDataFrame([(lots[k], u) for k, u in before], schemas.RENTSTAB_SUMMARY)
    new = spark.createDataFrame([(lots[k], u) for k, u in after], schemas.RENTSTAB_V2)
    pairs = [
        ("y" if k == 2 else "x", u, v)
        for k, u in before
        for other, v in after
        if other == k and v is not None and 0 < u >= v
    ]
    wanted = {
        g: (float(sum(u - v for h, u, v in pairs if h == g)), sum(u for h, u, _ in pairs if h == g))
        for g in {g for g, _, _ in pairs}
    }
    rows = counting.unit_losses(old, new, blocks).collect()
    assert {r.geoid: (r.dereg_units, r.dereg_pct) for r in rows} == {
        g: (lost, lost / had) for g, (lost, had) in wanted.items()
    }


def test_crosswalk_has_one_listed_area_per_block(spark, folder):
    found = crosswalk.block_crosswalk(views.parcels(spark, folder), views.area_list(spark, folder))
    assert found.groupBy("borocode", "block").count().filter("count > 1").isEmpty()
    assert found.join(views.area_list(spark, folder), "geoid", "left_anti").isEmpty()


def test_mapped_records_are_counted_once(spark, folder):
    blocks = crosswalk.block_areas(
        crosswalk.block_crosswalk(views.parcels(spark, folder), views.area_list(spark, folder))
    )
    rows = counting.located_evictions(views.evictions(spark, folder), blocks, "purchase")
    total = QUERIES["ind_evictions"](spark, folder).agg(F.sum("marsh_evic_num")).first()[0]
    assert rows.count() == total > 0


def test_every_named_member_has_one_outcome(spark, folder):
    outcomes = QUERIES["geocode_outcomes"](spark, folder).collect()
    people = views.members(spark, folder)
    assert sum(r.n_members for r in outcomes) == people.count()
    resolved = QUERIES["geocode_members"](spark, folder)
    work = QUERIES["unresolved_worklist"](spark, folder)
    assert resolved.join(work, "uid").isEmpty()
    assert resolved.select("uid").distinct().count() == resolved.count()
    dropped = sum(r.n_members for r in outcomes if r.outcome in ("no address", "blank override"))
    assert resolved.count() + work.count() + dropped == people.count()


def test_positions_lie_on_the_scale(spark, folder):
    rows = QUERIES["choropleth_scale"](spark, folder).filter(~F.col("is_missing")).collect()
    assert rows
    assert min(r.pos for r in rows) == 0.0
    assert max(r.pos for r in rows) == 1.0
