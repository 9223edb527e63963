"""Hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyseries.llm import hard_negatives as H


def brute(rows, step):
    sound = []
    for i, (vec_id, vector, label) in enumerate(rows):
        if vec_id is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            sound.append((i, vec_id, tuple(math.floor(256 * x) for x in vector), (label + 1) % 10 if vec_id % 7 == 0 else label))
    out = []
    for own, vec_id, vector, label in {r[1:]: r for r in reversed(sound)}.values():
        if vec_id % step:
            continue
        scores = [(-sum(a * b for a, b in zip(vector, w)), x, other) for i, x, w, other in sound if i != own and len(w) == len(vector)]
        for p, positive, _ in sorted(s for s in scores if s[2] == label)[:5]:
            fitting = sorted(s for s in scores if s[2] != label and -30 * p <= -100 * s[0] <= -90 * p)[:10]
            out += [(vec_id, positive, rank + 1, x, -p, -s) for rank, (s, x, _) in enumerate(fitting)]
    return sorted(out)


def mined(spark, rows, step=5, parts=3):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<float>, label int, rank int, size int").repartition(parts)
    found = H.hard_negatives(H.integer_rows(H.moved_labels(df)), F.col("vec_id") % step == 0)
    return sorted(tuple(r) for r in found.collect())


def rows_like(rng, n, size, spread=0.3, labels=4):
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(labels)]
    out = []
    for i in range(n):
        label = rng.randrange(labels)
        out.append((i, [c + rng.uniform(-spread, spread) for c in centres[label]], label))
    return out


@pytest.mark.parametrize("pilot", [16, 2])
def test_against_all_scores(spark, monkeypatch, pilot):
    monkeypatch.setattr(H, "BLOCK", 60)
    monkeypatch.setattr(H, "ANCHORS", 9)
    monkeypatch.setattr(H, "PILOT", pilot)
    rows = [(i, [round(x, 2) for x in v], c) for i, v, c in rows_like(random.Random(3), 400, 6)]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, v, c in rows]
    expected = brute(rows, 5)
    assert len(expected) > 1000 and mined(spark, rows) == expected


def test_odd_rows_copies_ties_and_other_sizes(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 15)
    rng = random.Random(5)
    half = lambda n: [rng.randrange(-4, 5) / 2 for _ in range(n)]
    rows = [(i, half(4), rng.randrange(3)) for i in range(-10, 40)] + [(100 + i % 3, [0.5] * 4, i % 2) for i in range(24)] + [(i, half(2), 1) for i in (200, 201)]
    rows += [(300, [math.nan] * 4, 1), (305, [math.inf] * 4, 1), (310, None, 1), (315, [None] + [1.0] * 3, 2), (None, half(4), 1), (320, half(4), None)]
    rows += [(400, [], 0), (405, [], 0), (406, [], 1), (410, [0.0] * 4, 0), (415, [0.0] * 4, 1), (5, rows[15][1], rows[15][2]), (5, half(4), 2)]
    assert mined(spark, rows) == brute(rows, 5)


def test_no_rows_one_row_one_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1), (6, [2.0], 1)]) == []
    # 65536 is the positive's score; of the two others only one lies in its window.
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1), (8, [0.5], 2), (9, [1.0], 2)]) == [(5, 6, 1, 8, 65536, 32768)]


def test_bounds_hold_and_close_rows_out():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 24))
    rows = np.floor(256 * (base[rng.integers(0, 6, 900)] + 0.2 * rng.normal(size=(900, 24)))).astype(np.int64)
    rows[:3] = [[0], [1], [10**6]]
    centres = H.directions(rows)
    norm, angle = H.angles(rows, centres)
    low, high = H.score_bounds(norm[:50], angle[:50], norm, angle)
    exact = rows[:50] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high - low < 0.9 * 2 * norm[:50, None] * norm[None]).mean() > 0.5


def test_only_overlapping_windows_are_scored(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    base = 4 * rng.normal(size=(4, 16))
    labels = rng.integers(0, 4, 600)
    vectors = np.floor(256 * (base[labels] + 0.1 * rng.normal(size=(600, 16)))).astype(np.int64)
    norm, angle = H.angles(vectors, H.directions(vectors))
    rows = pa.table({
        "vec_id": np.arange(600), "label": labels, "copies": np.ones(600, np.int64), "norm": norm,
        "vector": pa.array(list(vectors)), "angles": pa.array(list(angle)),
    })
    block, anchors = H.Block(rows), rows.slice(0, 10)
    scored = 0

    class Counted(np.ndarray):
        def __matmul__(self, other):
            nonlocal scored
            scored += len(self)
            return np.asarray(self) @ other

    block.vectors = block.vectors.view(Counted)
    best = int((vectors[0] @ vectors.T).max())
    list(block.negatives(anchors, [[(int(0.99 * best), best)]] * 10, 10))
    assert scored < 0.6 * 10 * 600
