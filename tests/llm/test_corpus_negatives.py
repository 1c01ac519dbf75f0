"""Hard negatives against brute force, and the parts they are made of."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5):
    known = [
        (i, [math.floor(256 * x) for x in v], label)
        for i, v, label in rows
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, v, label in sorted({(i, tuple(v), label) for i, v, label in known if i % 100 == 0}):
        scores = [(sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, w, m in known if j != i or m != label]
        ranked = sorted(scores, key=lambda s: (-s[0], s[1]))
        for p, j, _ in [s for s in ranked if s[2] == label][:positives]:
            window = [s for s in ranked if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p][:negatives]
            out += [(i, j, rank, n, p, score) for rank, (score, n, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    found = hn.hard_negatives(table, F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


def vectors(seed, n, labels=3, width=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(2)]
    return [
        (i * 10, [float(np.float32(c + rng.gauss(0, 0.1))) for c in rng.choice(centres)], rng.randrange(labels))
        for i in range(n)
    ]


def test_products_are_exact_for_every_shape_even_where_partial_sums_overflow():
    random_ = np.random.default_rng(0)
    for m, k, n in ((1, 1, 1), (17, 64, 33), (100, 7, 50), (8, 8, 8), (65, 130, 257), (3, 0, 2)):
        a, b = random_.integers(-(2**62), 2**62, (m, k)), random_.integers(-(2**62), 2**62, (k, n))
        assert (hn.product(a, b) == a @ b).all()
    big = np.full((16, 16), 2**31 - 1)
    big[:, 1:] = 0
    assert (hn.product(big, big.T.copy()) == (2**31 - 1) ** 2).all()


def test_seven_products_at_each_level(monkeypatch):
    leaves = []
    plain = hn._multiply
    monkeypatch.setattr(hn, "_multiply", lambda a, b, n: leaves.append(n) or plain(a, b, n))
    hn.product(np.ones((64, 64), int), np.ones((64, 64), int))
    assert [leaves.count(n) for n in (3, 2, 1, 0)] == [1, 7, 49, 343]


def test_bounds_of_windows_stay_within_64_bits():
    scores = np.array([-11, -10, -1, 0, 1, 2, 4, 5, 6, 2**62, 2**63 - 1, -(2**63)])
    assert [int(x) for x in hn.lowest(scores)] == [math.ceil(Fraction(4 * int(s), 5)) for s in scores]


def test_heaps_merge_in_any_order():
    rng = random.Random(1)
    entries = [(rng.randrange(3), rng.randrange(6), rng.randrange(50)) for _ in range(300)]
    wanted = {k: sorted((-s, i) for key, s, i in entries if key == k)[:4] for k in range(3)}
    for size in (1, 7, 300):
        heaps = hn.Heaps(3, 4)
        for at in range(0, 300, size):
            heaps.push(*(np.array(c) for c in zip(*entries[at : at + size], strict=True)))
        got = {k: [] for k in range(3)}
        for k, s, i in zip(heaps.key, heaps.score, heaps.id, strict=True):
            got[k].append((-s, i))
        assert got == wanted
        assert [heaps.worst[k] for k in range(3)] == [-wanted[k][-1][0] for k in range(3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force_in_many_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "ANCHORS", 7)
    monkeypatch.setattr(hn, "CANDIDATES", 40)
    rows = vectors(seed, 300)
    wanted = brute(rows)
    assert len(wanted) > 100
    assert mined(spark, rows) == wanted
    assert mined(spark, rows, positives=2, negatives=9) == brute(rows, 2, 9)


def test_ties_repeats_nulls_and_odd_numbers(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [0.5, 0.25, -0.125], i % 2) for i in range(0, 260, 20)]
    odd = [
        (None, [0.5, 0.25, -0.125], 0), (21, None, 0), (22, [0.5, None, 0.0], 1), (23, [0.5, nan, 0.0], 1),
        (24, [0.5, inf, 0.0], 0), (25, [0.5, -inf, 0.0], 0), (26, [0.5, 0.25, -0.125], None), (27, [0.5], 1),
        (28, [], 1), (29, [0.5, 0.25, -0.125, 7.0], 1), (300, [], 1), (400, [0.0], 0), (401, [1e30], 0), (500, [-0.9], 1),
    ]
    repeats = [(0, [0.5, 0.25, -0.125], 0), (0, [0.5, 0.25, -0.125], 1), (20, [0.5, 0.25, -0.125], 0), (100, [0.5], 0)]
    rows = [r for r in same + odd + repeats if r[0] != 401]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, same + odd + repeats)  # a component beyond 64 bits stops nothing


def test_empty_tables_and_foreign_columns(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    rows = vectors(3, 120)
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "row", "no", "a", "b", "vector", "anchors", "rank", "score", "asks", "positives"):
        table = table.withColumn(name, F.lit("own"))
    found = hn.hard_negatives(table, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    renamed = table.withColumnsRenamed({"vec_id": "my id", "embedding": "x.y", "label": "anchor_id"})
    found = hn.hard_negatives(renamed, F.col("my id") % 100 == 0, "my id", "x.y", "anchor_id")
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
