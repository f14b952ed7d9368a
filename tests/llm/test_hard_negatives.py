"""Hard negatives against whole-number products of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.llm import hard_negatives as H
from understory.llm.hard_negatives import hard_negatives

COLUMNS = "vec_id long, label int, embedding array<double>, node string, score int"


def plain(rows, every=10):
    part = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in part:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in part if j != i and len(w) == len(v))
        for ps, p in [(-s, j) for s, j, z in others if z == y][:5]:
            fits = [(-s, j) for s, j, z in others if z != y and 80 * ps <= -100 * s <= 100 * ps][:5]
            out += [(i, p, r, n, ps, ns) for r, (ns, n) in enumerate(fits, 1)]
    return sorted(out)


def found(frame):
    return sorted(map(tuple, frame.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def mined(spark, rows, parts=4):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS).repartition(parts)
    return found(hard_negatives(frame, F.col("vec_id") % 10 == 0))


def clustered(seed, n, dim):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((6, dim))
    picks = rng.integers(6, size=n)
    return [(i, int(p if rng.random() < 0.8 else rng.integers(6)), (centers[p] + 0.4 * rng.standard_normal(dim)).tolist())
            for i, p in enumerate(picks)]


@pytest.mark.parametrize("dim", [3, 64, 70])
def test_against_all_pairs(spark, dim):
    rows = clustered(dim, 400, dim)
    expected = plain(rows)
    assert len(expected) > 300
    assert mined(spark, rows) == expected


def test_small_passes_and_slices(spark, monkeypatch):
    rows = clustered(1, 300, 16)
    monkeypatch.setattr(H, "PASS_BYTES", 8000)
    monkeypatch.setattr(H, "_PAIRS", 64)
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (10, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [1.0, 0.4]), (2, 2, [0.9, 0.5]), (3, 2, [1.0, 0.4]),
            (4, None, [1.0, 0.5]), (5, 1, None), (6, 1, [float("nan"), 1.0]), (7, 1, [None, 1.0]), (None, 1, [1.0, 1.0]),
            (8, 1, [float("inf"), 1.0]), (9, 2, [1.0, 0.5, 0.0]), (20, 2, [1.0, 0.5, 0.0]), (30, 3, []), (31, 3, []), (32, 4, []),
            (40, 5, [0.0, 0.0]), (41, 5, [0.0, 0.0]), (50, 1, [-1.0, -0.5]), (10, 2, [1.0, 0.5])]
    expected = plain(rows)
    assert mined(spark, rows) == expected and {r[0] for r in expected} >= {0, 10, 30, 40}


def test_components_beyond_exact_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.standard_normal(4) * 10.0 ** (i % 8)).tolist()) for i in range(120)]
    assert max(abs(r[4]) for r in plain(rows)) > 2**53
    assert mined(spark, rows) == plain(rows)
    huge = [(0, 1, [1e300, 1e300]), (1, 1, [1e300, 1.0]), (2, 2, [1e305, -1e305]), (3, 2, [1e308, 1e308])]
    assert [r[:4] for r in mined(spark, huge)] == [(0, 1, 1, 3)]  # scores end at the largest long


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert found(hard_negatives(spark.createDataFrame([], COLUMNS), F.col("vec_id") % 10 == 0)) == []


def test_intervals_hold_and_pass_over_rows():
    import pandas as pd

    rows = np.array([r[2] for r in clustered(0, 500, 64)])
    frame = pd.DataFrame({"v": list(rows), "node": range(500), "vec_id": range(500), "label": 0})
    index = pd.concat(H._encode(iter([frame])))
    to = H.Anchors(index[:40], 64)
    code = np.array(index["code"].tolist(), np.int64).view(np.uint64)
    low, high = to.intervals(code, index["norm"].to_numpy(), index["align"].to_numpy())
    whole = np.floor(256 * rows)
    exact = whole @ whole[:40].T
    assert (low <= exact).all() and (exact <= high).all()
    best = np.sort(exact, axis=0)[-6]
    assert 0.02 < (high >= best).mean() < 0.98


def test_index_has_codes_for_long_vectors():
    rows = np.random.default_rng(2).standard_normal((3, 1500))
    assert np.allclose(np.linalg.norm(H.rotate(rows), axis=1), np.linalg.norm(rows, axis=1))
