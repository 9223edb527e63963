"""Greedy token counts and n-best segmentations against all ways to cut."""

import random
import zlib
from array import array

import pytest
from hypothesis import given
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from skyseries.llm import piece_nbest as N
from skyseries.llm import token_counts as C
from skyseries.llm.queries import COUNTING_VOCABULARY, PIECE_MODEL


def greedy(pieces, symbols):
    at, count = 0, 0
    while at < len(symbols):
        size = max((n for n in range(1, len(symbols) - at + 1) if symbols[at: at + n] in pieces), default=0)
        if not size:
            return None
        at, count = at + size, count + 1
    return count


WORDS = st.lists(st.sampled_from([1, 2, 3]), min_size=1, max_size=5).map(tuple)


@given(st.sets(WORDS, min_size=1, max_size=12), st.lists(WORDS, max_size=5))
def test_automaton_counts_like_the_greedy_loop(pieces, parts):
    symbols = tuple(s for part in parts for s in part)
    assert C.LongestMatch(pieces).count(symbols) == greedy(pieces, symbols)


def test_counts_of_whole_texts(spark):
    pieces = set(C.word_end_vocabulary(COUNTING_VOCABULARY))
    rng = random.Random(1)
    texts = [None, "", " \n", "Hello, World!!", "12a é漢字 naïve", "x" * 300] + [" ".join(rng.choice(["Thing", "of-ten", "Straße.", "a1"]) for _ in range(40)) for _ in range(10)]
    rows = list(enumerate(texts)) + [(None, "Twice"), (None, "Twice")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, n_words int")
    expected = []
    for doc, text in rows:
        words = [p for chunk in (text or "").split() for p in C.parts(chunk)]
        sizes = [greedy(pieces, C.word_symbols(w)) for w in words]
        expected.append((doc, len(words), sum(sizes), 0))
    assert sorted((tuple(r) for r in C.counts(df, COUNTING_VOCABULARY).collect()), key=repr) == sorted(expected, key=repr)
    assert C.counts(df.limit(0), COUNTING_VOCABULARY).collect() == []


@pytest.fixture(scope="module")
def lattice():
    return N.PieceLattice(PIECE_MODEL)


def every_path(lattice, text):
    """Scores and ids of all segmentations."""
    text = N.SPACE + text.replace(" ", N.SPACE)
    ending, _ = lattice.forward(text)
    paths = [[(0.0, ())]]
    for place in range(1, len(text) + 1):
        paths.append([(s + score, ids + own) for _, a, own, score in ending[place] for s, ids in paths[a]])
    return sorted(paths[-1], key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["the", "of the", "thing", "a\nb", "naïve", "漢 x", "  a", "ending. "])
def test_best_paths_in_the_order_of_their_scores(lattice, text):
    every, found = every_path(lattice, text), lattice.n_best(text, 7)
    assert [s for s, _ in found] == [s for s, _ in every[:7]]
    allowed = {(s, ids) for s, ids in every}
    assert len({tuple(ids) for _, ids in found}) == len(found) and all((s, tuple(ids)) in allowed for s, ids in found)
    assert all(lattice.decode(ids) == text for _, ids in found)


def test_n_best_is_one_search_over_the_whole_text(lattice, monkeypatch):
    text, searched, forward = "of the naïve\nthing  12 漢", [], lattice.forward
    monkeypatch.setattr(lattice, "forward", lambda unit: searched.append(unit) or forward(unit))
    found = lattice.n_best(text, 40)
    assert searched == [N.SPACE + text.replace(" ", N.SPACE)]
    assert len({tuple(ids) for _, ids in found}) == 40 and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    # The units of the text give the same two.
    units = [lattice.unit_best(u, 2) for u in N.units(text)]
    best = sum(u[0][0] for u in units)
    assert found[0][0] == pytest.approx(best) and found[0][1] == [i for u in units for i in u[0][1]]
    assert found[1][0] == pytest.approx(best - min(u[0][0] - u[1][0] for u in units if len(u) > 1))
    assert lattice.n_best("", 3) == [(0.0, [])]


def test_many_units_at_once_are_searched_like_each_alone(lattice, monkeypatch):
    monkeypatch.setattr(N, "TOGETHER", 50)
    rng = random.Random(11)
    parts = ["th", "tion", "er", "s", "é", "ing", ".", "1", "the", N.SPACE] * 6 + ["漢", "\0", "\n", "𐀀"]
    given = list({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(900)})
    found = lattice.two_best(given)
    assert sum(f is None for f in found) < 500
    for unit, both in zip(given, found):
        (score, ids), *second = lattice.unit_best(unit, 2)
        if both is None:
            assert len(unit) > N.WIDTHS[-1] or any(not lattice.starts.get(c) for c in unit)
            continue
        assert both[0] == score and both[1] == (score - second[0][0] if second else float("inf"))
        assert both[2] == b"".join(i.to_bytes(4, "little") for i in ids)
        assert both[3] == b"".join(lattice.output[i] for i in ids)


@given(st.text(st.sampled_from("ab  \n" + N.SPACE + "\0"), max_size=12))
def test_units_are_cut_where_no_piece_runs_on(lattice, text):
    marked, own = N.SPACE + text.replace(" ", N.SPACE), N.units(text)
    assert "".join(own) == (marked if text else "")
    at = 0
    for unit in own[:-1]:
        at += len(unit)
        assert not any(marked[a:b] in lattice.starts and lattice.starts[marked[a:b]] for a in range(at) for b in range(at + 1, len(marked) + 1))


def test_every_piece_of_a_text_is_an_edge(lattice):
    text = N.SPACE + "international understandings 12"
    ending, _ = lattice.forward(text)
    found = {(a, b, ids) for b, edges in enumerate(ending) for _, a, ids, _ in edges}
    pieces = {(a, b, lattice.starts[text[a:b]][0]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if lattice.starts.get(text[a:b])}
    assert pieces <= found and all(b - a == 1 for a, b, _ in found - pieces)
    assert max(b - a for a, b, _ in pieces) > N.LOOK


@given(st.text(st.sampled_from("abé 漢\n\t.T"), max_size=30))
def test_round_trip_and_pieces_of_the_model(lattice, text):
    (_, ids), *_ = lattice.n_best(text, 1)
    assert lattice.decode(ids) == text
    if ids:
        processor = SentencePieceProcessor(model_file=PIECE_MODEL)
        assert processor.decode(ids) == processor.decode(processor.encode(text))


def test_segmentations_of_whole_texts(spark, lattice):
    texts = [None, "", "a", "Thing of the naïve 漢\n\n  end ", "x" * 400, f"mark{N.SPACE}"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a", 0)] * 2, "doc_id bigint, text string, score int")
    found = {r.doc_id: r for r in N.segmentations(df, PIECE_MODEL).collect()}
    for i, text in enumerate(texts):
        best = lattice.n_best(text or "", 2)
        second = best[1][0] if len(best) > 1 else None
        assert (found[i].n_pieces, found[i].score, found[i].runner_up) == (len(best[0][1]), best[0][0], second)
        assert found[i].restored == (N.SPACE not in (text or ""))
    assert found[None].n_pieces == found[2].n_pieces
    assert N.segmentations(df.limit(0), PIECE_MODEL).collect() == []


def test_paths_through_units_are_those_through_the_whole_text(lattice):
    rng = random.Random(5)
    parts = ["th", "ing", "e ", " ", "naïve", "漢", "\n", "12", "xyzzy", "s", "er" * 20]
    for n in [1, 2, 3, 9] * 20:
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        own = N.units(text)
        runs = [lattice.run(unit) for unit in own]
        for both, run in zip(lattice.two_best(own), runs):
            assert both is None or (both[:4], both[4]) == (run[:4], run[4][:1])
        found, whole = lattice.paths(own, runs, n), lattice.n_best(text, n)
        assert [s for s, _ in found] == [s for s, _ in whole] and len({ids for _, ids in found}) == len(found)
        # Where scores tie, the order of a long list may differ; the two best are the same paths.
        assert [(s, list(array("I", ids))) for s, ids in found[:2]] == whole[:2]
        # Each is a path of its own score.
        scores = {ids: s for s, ids in lattice.unit_best(N.SPACE + text.replace(" ", N.SPACE), 400)} if text else {(): 0.0}
        assert all(scores[tuple(array("I", ids))] == s for s, ids in found)


def test_rows_come_from_one_search_over_each_whole_text(spark, lattice):
    texts = ["Thing of the naïve 漢\n\n  end ", "the same the same", "a", "", None, "y" * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for row in N.segmentations(df, PIECE_MODEL).collect():
        best, *second = lattice.n_best(texts[row.doc_id] or "", 2)
        ids = [zlib.crc32(array("I", own).tobytes()) for _, own in (best, *second)]
        # The second segmentation itself, not its score alone.
        assert [row.ids_crc32, row.runner_up_crc32] == (ids + [None])[:2]
        assert row.runner_up == (second[0][0] if second else None)
