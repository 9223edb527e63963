"""The recurrent network against one written out byte by byte, its gradients, and its held-out accuracy."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyseries.llm import language_gru as L
from skyseries.llm.frames import table

SF_DIR = "/root/testdata/sf0.01"


def precise(network):
    for d in (network.ahead, network.back):
        d.table, d.state, d.bias = (a.astype(float) for a in (d.table, d.state, d.bias))
    network.weights, network.bias = network.weights.astype(float), network.bias.astype(float)
    return network


def plain(network, text: bytes):
    """Probabilities at each position of one window, one byte and one unit after the other."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(d, codes):
        h, out = np.zeros(len(d.bias)), []
        for c in codes:
            r, z, n = np.split(d.table[c], 3)
            ur, uz, un = np.split(h @ d.state, 3)
            new = np.tanh(n + sigmoid(r + ur) * (un + d.bias))
            update = sigmoid(z + uz)
            h = (1 - update) * new + update * h
            out.append(h)
        return out

    both = [np.concatenate(p) for p in zip(states(network.ahead, text), states(network.back, text[::-1])[::-1])]
    scores = [np.exp(b @ network.weights + network.bias) for b in both]
    return np.array([s / s.sum() for s in scores])


def test_windows_cover_every_byte_once():
    texts = ["", "a", "ä" * 48, "x" * (L.WINDOW + 1), "y" * (5 * L.WINDOW), "z" * 1000]
    offsets, data = L.utf8(pa.array(texts))
    owner, first, sizes = L.windows_of(offsets)
    assert sizes.max() <= L.WINDOW and sizes.min() > 0
    covered = np.concatenate([np.arange(f, f + n) for f, n in zip(first, sizes)])
    assert covered.tolist() == list(range(len(data)))
    assert all(offsets[o] <= f and f + n <= offsets[o + 1] for o, f, n in zip(owner, first, sizes))


def test_network_position_by_position():
    network = precise(L.Network.new(["a", "b", "c"], np.random.default_rng(1), 5))
    texts = ["Hello wörld. ", "x", "longer text " * 30, ""]
    found = L.Predictor(network).probabilities(pa.array(texts))
    for text, row in zip(texts, found):
        data, parts = text.encode(), []
        offsets = np.array([0, len(data)])
        for _, a, n in zip(*L.windows_of(offsets)):
            parts.append(plain(network, data[a: a + n]))
        expected = np.concatenate(parts).mean(axis=0) if parts else np.zeros(3)
        assert np.allclose(row, expected, atol=1e-9)


def test_gradients():
    rng = np.random.default_rng(3)
    network = precise(L.Network.new(["a", "b"], rng, 3))
    codes = rng.integers(0, 7, (6, 4))
    sizes, labels = np.array([6, 3, 1, 5]), np.array([0, 1, 1, 0])
    codes = np.where(np.arange(6)[:, None] < sizes, codes, 0)
    _, found = network.gradients(codes, sizes, labels)
    for array, gradient in zip(network.arrays(), found):
        places = [tuple(rng.integers(0, n) for n in array.shape) for _ in range(12)]
        if array.shape[0] == 256:
            places = [(int(c), p[1]) for c, p in zip(codes[:, 0], places)]
        for place in places:
            was = array[place]
            losses = []
            for change in (1e-5, -1e-5):
                array[place] = was + change
                losses.append(network.gradients(codes, sizes, labels)[0])
            array[place] = was
            assert abs((losses[0] - losses[1]) / 2e-5 - gradient[place]) < 1e-6


ODD = [(None, "abc", "x", 1), (1, None, "x", 1), (2, "", "x", 2), (3, "12 34 !?", "y", 3), (4, "é", "y", 4), (5, "word " * 5000, None, 5), (5, "word " * 5000, None, 5)]


@pytest.mark.parametrize("n", [0, 40])
def test_odd_rows_no_labels_and_clashing_columns(spark, n):
    taught = [(100 + i, ("abab cdcd " if i % 2 else "xyz zyx ") * 9, "y" if i % 2 else "x", 0) for i in range(n)]
    docs = spark.createDataFrame(ODD + taught, "doc_id bigint, text string, lang string, n int").repartition(3)
    network = L.train(docs.where("doc_id is null or doc_id > 4"))
    out = L.predicted(docs, network)
    assert out.columns == ["doc_id", "text", "lang", "n", "lang_pred", "score"]
    rows = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD) + n
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in rows.values())
    if n:
        assert rows[4].lang_pred in ("x", "y")
        assert all(rows[100 + i].lang_pred == ("y" if i % 2 else "x") for i in range(n))
    else:
        assert network is None and rows[None].lang_pred == "und"
    assert L.predicted(docs.limit(0), network).collect() == []


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "same text again" if i % 3 else f"text number {i} of many", "en") for i in range(600)]
    rows = [(i, t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    taken = []
    original, L.fit = L.fit, lambda rows: taken.extend(rows)
    try:
        L.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), train_docs=50)
    finally:
        L.fit = original
    assert len(taken) == len(set(taken)) == 50


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the given tables are absent")
def test_held_out_accuracy(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = L.predicted(docs, L.train(docs)).where(L.held_out(F.col("doc_id"))).where("length(text) > 40 and lang is not null").collect()
    assert len(rows) > 200
    assert sum(r.lang_pred == r.lang for r in rows) > 0.98 * len(rows)


@pytest.mark.parametrize("windows", [1, 3, 200])
def test_states_are_the_same_numbers_as_in_fitting(windows):
    rng = np.random.default_rng(windows)
    direction = L.Direction.new(rng)
    direction.bias += rng.normal(size=L.UNITS).astype(np.float32)
    codes = rng.integers(0, 256, (20, windows)).astype(np.uint8)
    kept, _ = direction.forward(codes, keep=True)
    assert (direction._states(codes) == kept).all()


def test_reading_takes_no_tanh(monkeypatch):
    network = L.Network.new(["a", "b"], np.random.default_rng(5))
    texts = pa.array(["one text", "another, longer text " * 20])
    expected = L.Predictor(precise(network)).probabilities(texts)
    network = L.Network.new(["a", "b"], np.random.default_rng(5))
    # It costs as much as two exponentials and took half of all time.
    monkeypatch.delattr(L.np, "tanh")
    assert np.allclose(L.Predictor(network).probabilities(texts), expected, atol=1e-5)


@pytest.mark.parametrize("size", [-300, 300])
def test_saturated_gates(size):
    direction = L.Direction.new(np.random.default_rng(6))
    direction.table += np.float32(size)
    found = direction.forward(np.zeros((4, 2), np.uint8))
    assert np.isfinite(found).all()
    # Low gates take the candidate, high ones keep the zero they began with.
    assert np.allclose(found, -1 if size < 0 else 0)
