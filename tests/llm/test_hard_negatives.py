import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelwright.llm import hard_negatives as hn


def brute(rows, every=1, k=5):
    good = [
        (i, y, [math.floor(256 * x) for x in v])
        for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, y, x in good:
        if a % every:
            continue
        score = lambda v: sum(p * q for p, q in zip(x, v, strict=False))
        others = sorted((-score(v), i, z) for i, z, v in good if i != a)
        for s, p, _ in [o for o in others if o[2] == y][:k]:
            found = [(n, t) for t, n, z in others if z != y and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(a, p, r, n, -s, -t) for r, (n, t) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, every=1):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score int, slot string")
    return sorted(tuple(r)[:6] for r in hn.mine(frame, hn.F.col("id") % every == 0).collect())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 30, 2**10, 2**20, 2**24, 2**40]))
def test_packed_products_are_exact(seed, size):
    rng = np.random.default_rng(seed)
    a, c = rng.integers(-size, size + 1, (3, 7)), rng.integers(-size, size + 1, (11, 7))
    bound = max(np.linalg.norm(a.astype(float), axis=1)) * max(np.linalg.norm(c.astype(float), axis=1)) * 1.000001
    fields = hn.Fields.for_bound(bound)
    whole = a.astype(object) @ c.astype(object).T
    assert (fields.products(a, c)(slice(0, 3)) == np.clip(whole, -hn._LONG, hn._LONG)).all()


def test_small_bounds_share_one_integer():
    assert hn.Fields.for_bound(60).count >= 6
    assert hn.Fields.for_bound(70_000).count == 2
    assert hn.Fields.for_bound(float("inf")).count == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 1 << 61]))
def test_top_breaks_ties_by_column(seed, size):
    rng = np.random.default_rng(seed)
    scores = rng.integers(-size, size, (4, 9))
    allowed = rng.random((4, 9)) < 0.6
    row, column = hn.top(scores, allowed, 3)
    for i in range(4):
        want = sorted((-int(scores[i, j]), j) for j in range(9) if allowed[i, j])[:3]
        assert sorted((-int(scores[i, j]), j) for j in column[row == i]) == want


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 0.2), 1) for _ in range(6)], rng.randint(0, 2)) for i in range(150)]
    assert mined(spark, rows, 3) == brute(rows, 3)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, [0.9, 1.0], 2), (4, [0.9, 1.0], 2), (5, [1.0, 0.9], 2),
        (6, None, 1), (7, [1.0, None], 1), (8, [nan, 1.0], 2), (9, [inf, 1.0], 2), (10, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
        (11, [], 2), (12, [1.0], 2), (13, [-1.0, -1.0], 1), (14, [1.9, 0.0, 5.0], 2), (15, [0.95, 0.95], 3), (16, [0.95, 0.95], 3), (17, [0.95, 0.95], 4),
    ]
    assert mined(spark, rows) == brute(rows)


def test_very_large_components(spark):
    rows = [(0, [1e9, 1.0], 1), (1, [1e9, 2.0], 1), (2, [9e8, 1.0], 2), (3, [1.0, 1.0], 2)]
    got = mined(spark, rows)
    assert [g[:4] for g in got] == [(0, 1, 1, 2), (1, 0, 1, 2)]


def test_repeated_ids_and_empty_tables(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.4], 2), (2, [1.0, 0.4], 2)]
    got = [g for g in mined(spark, rows, 5)]
    assert [g[:4] for g in got] == [(0, 1, 1, 2), (0, 1, 2, 2)]
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)], 5) == []


@pytest.mark.parametrize("passes", [2])
def test_anchors_in_several_passes(spark, monkeypatch, passes):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)], rng.randint(0, 3)) for i in range(60)]
    monkeypatch.setattr(hn, "SENT_BYTES", 60 * 6 * 8 // passes)
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, v, y in rows]
    assert mined(spark, rows) == brute(rows)
