"""Hard negatives against brute force, and on odd rows; the query itself is checked by its SQL."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, list long, `odd.name` string"


def brute(rows, is_anchor, positives=5, negatives=5):
    rows = [
        (k, [math.floor(256 * x) for x in v], label)
        for k, v, label in rows
        if k is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) and abs(x) < 2**15 for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  the shorter one ends in zeros
    out = []
    for k, v, label in rows:
        if not is_anchor(k):
            continue
        scored = sorted((-dot(v, w), o, other) for o, w, other in rows if o != k or other != label)
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 80 * -score <= 100 * -s[0] <= 100 * -score][:negatives]
            out += [(k, positive, rank, other, -score, -s) for rank, (s, other, _) in enumerate(fit, 1)]
    return sorted(out)


def mine(spark, rows, step, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(frame, F.col("vec_id") % step == 0, **options).collect())


@pytest.mark.parametrize("dimension", [2, 24])
def test_same_as_all_pairs(spark, dimension, monkeypatch):
    rng = np.random.default_rng(dimension)
    centres = rng.normal(size=(4, dimension))
    rows = [(i, (centres[i % 4] + rng.normal(size=dimension) * 0.8).round(1).tolist(), int(rng.integers(3))) for i in range(500)]
    rows += [(500 + i, rows[i][1], (rows[i][2] + i) % 3) for i in range(100)]  # repeated vectors, so ties
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 13)  # several blocks
    wanted = brute(rows, lambda k: k % 9 == 0)
    assert mine(spark, rows, 9) == wanted and len(wanted) > 100
    assert mine(spark, rows, 50, positives=2, negatives=1) == brute(rows, lambda k: k % 50 == 0, 2, 1)


def test_bounds_hold_and_leave_pairs_out():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * np.concatenate([rng.normal(size=(300, 8)) * 0.1 + centre for centre in rng.normal(size=(5, 8))])).astype(np.int64)
    vectors[7] = 0
    norms = np.linalg.norm(vectors, axis=1)
    references = hard_negatives.reference_directions(vectors[::3].astype(np.float64))
    angles = hard_negatives.angles_to(vectors.astype(np.float64), norms, references)
    rows = hard_negatives.Rows(np.arange(len(vectors)), np.zeros(len(vectors)), vectors, norms, angles)
    low, high = hard_negatives.score_bounds(rows, rows)
    score = vectors @ vectors.T
    assert (low <= score).all() and (score <= high).all()
    assert (high < np.sort(score, axis=1)[:, -300:-299]).mean() > 0.5  # cannot be among the best 300


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5], 1), (1, [0.9, 0.5], 1), (2, [0.95, 0.45], 2), (2, [0.95, 0.45], 2), (3, None, 1), (4, [1.0, None], 1),
        (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [1.0, 0.5], 2), (7, [1.0, 0.5], None), (8, [], 2),
        (9, [0.9], 2), (10, [1e9, 1.0], 2), (11, [0.0, 0.0], 1), (12, [-1.0, -1.0], 1), (0, [1.0, 0.4], 2),
    ]
    assert mine(spark, rows, 12) == brute(rows, lambda k: k % 12 == 0)
    assert mine(spark, rows, 1) == brute(rows, lambda k: True)
    assert mine(spark, [], 1) == [] and mine(spark, rows[:3], 1000) == brute(rows[:3], lambda k: k == 0)
