"""Exact top-k search against a full sort."""

import math
import random

import numpy as np

from skyseries.llm import va_topk as V


def brute(rows, step, k):
    sound = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in sound if i % step == 0}:
        # Of the rows equal to the query one is its own.
        others = list(sound)
        others.remove((q, list(v)))
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in others if len(w) == len(v)))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
    return sorted(out)


def search(spark, rows, step=5, k=4, parts=3):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int").repartition(parts)
    vectors = V.integer_vectors(df, "vec_id", "embedding")
    return sorted(tuple(r) for r in V.top_k(vectors, vectors.where(f"vec_id % {step} = 0"), k).collect())


def test_ties_copies_negative_ids_nulls_and_other_sizes(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 20)
    monkeypatch.setattr(V, "QUERIES", 6)
    rng = random.Random(8)
    half = lambda n: [rng.randrange(-4, 5) / 2 for _ in range(n)]
    rows = [(i, half(6)) for i in range(-10, 60)] + [(i, [0.5] * 6) for i in range(100, 160)] + [(i, half(2)) for i in (200, 201)]
    rows += [(300, [math.nan] * 6), (305, [math.inf] * 6), (310, None), (315, [None] + [1.0] * 5), (None, half(6)), (400, []), (405, []), (3, rows[0][1]), (5, half(6))]
    rows += [(0, rows[10][1]), (0, rows[10][1]), (5, half(6)), (10, rows[20][1])]
    assert search(spark, rows) == brute(rows, 5, 4)


def test_floors_of_the_first_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 10)
    monkeypatch.setattr(V, "PILOT", 4)
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-8, 9) / 8 for _ in range(5)]) for i in range(300)] + [(i, [0.5] * 5) for i in range(400, 450)]
    assert search(spark, rows, step=20) == brute(rows, 20, 4)
    file = V.ApproximationFile(np.arange(100), np.arange(100)[:, None] * np.ones((1, 3), np.int64))
    _, ids, scores = file.search(np.array([500]), np.ones((1, 3), np.int64), 10, np.array([288]))
    assert ids.tolist() == [99, 98, 97, 96] and scores.tolist() == [297, 294, 291, 288]


def test_bounds_allow_for_rounding_of_large_terms():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-(2**29), 2**29, (400, 8))
    query = rng.integers(-(2**29), 2**29, (5, 8))
    query[0] = vectors[0]
    exact = [[sum(int(a) * int(b) for a, b in zip(q, v)) for v in vectors] for q in query]
    least, most = V.ApproximationFile(np.arange(400), vectors).bounds(query)
    assert all(low <= e <= high for row, lows, highs in zip(exact, least, most) for e, low, high in zip(row, lows, highs))


def test_fewer_than_k_and_no_rows(spark):
    assert search(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 1024 * 2048)]
    assert search(spark, [(5, [1.0])]) == []
    assert search(spark, []) == []


def test_a_block_finds_its_best_without_reading_all():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-1000, 1000, (500, 16))
    block = V.ApproximationFile(np.arange(500), vectors)
    least, most = block.bounds(vectors[:9])
    exact = vectors[:9] @ vectors.T
    assert (least <= exact).all() and (exact <= most).all()
    place, ids, scores = block.search(np.arange(9), vectors[:9], 5)
    for q in range(9):
        order = sorted((-exact[q, i], i) for i in range(500) if i != q)[:5]
        assert [(-s, i) for s, i in zip(scores[place == q].tolist(), ids[place == q].tolist())] == order


def test_bounds_are_held_for_a_few_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(5)
    ids, vectors = np.arange(900), rng.integers(-9, 10, (900, 4))
    file, sizes, bounds = V.ApproximationFile(ids, vectors), [], V.ApproximationFile.bounds
    monkeypatch.setattr(V.ApproximationFile, "bounds", lambda self, queries: sizes.append(len(queries)) or bounds(self, queries))
    place, found, score = file.search(ids, vectors, 3)
    assert max(sizes) <= 256 and sum(sizes) == 900
    exact = vectors @ vectors.T
    best = [[i for i in np.lexsort((ids, -exact[q])) if i != q][:3] for q in ids]
    assert place.tolist() == np.repeat(ids, 3).tolist() and found.tolist() == np.concatenate(best).tolist()
    assert score.tolist() == [exact[q, i] for q in ids for i in best[q]]
