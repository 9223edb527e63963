"""Packing: ids against the tokenizer, cuts against all cuts, and the round trip of every id."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyseries.llm import packing as P
from skyseries.llm.queries import PACKING_TOKENIZER


@pytest.fixture(scope="module")
def tokenizer():
    tokenizer = Tokenizer.from_file(PACKING_TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(PACKING_TOKENIZER)


PIECES = st.sampled_from(["a", "Thing", " ", "  ", "\n", "\t", ".", "!", "'s", "é", "12", " ", " ", "<|endoftext|>", "漢", "\r", "\x1c", "\x85"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_pieces_between_spaces_give_the_ids_of_the_whole_text(tokenizer, encoder, pieces):
    text = "".join(pieces)
    assert encoder([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


UNCHANGED, ADDED = Tokenizer.from_file(PACKING_TOKENIZER), P.Encoder(PACKING_TOKENIZER, added=True)


def price(places, penalties, cuts, window):
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        size = places[b] - places[a]
        total += (0 if size & (size - 1) == 0 else window - size) + penalties[b] + P.PER_WINDOW
    return total


def test_cuts_cost_no_more_than_any_others():
    rng = random.Random(4)
    for _ in range(200):
        places = [0]
        for _ in range(rng.randrange(1, 12)):
            places.append(places[-1] + rng.randrange(1, 16))
        penalties = [0, *(rng.choice([0, 2, 12]) for _ in places[1:])]

        @lru_cache(None)
        def least(j):
            if j == 0:
                return 0
            return min(least(i) + price(places, penalties, [i, j], 16) for i in range(j) if places[j] - places[i] <= 16)

        cuts = P.best_cuts(places, penalties, 16)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        assert price(places, penalties, cuts, 16) == least(len(places) - 1)


def texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "thion", "Größe", "x", "ñandú."])
    out = [None, "", "a", "\n\n", "no end " * 4000, "." * 3000]
    return out + [" ".join(word() for _ in range(rng.randrange(1, 900))) for _ in range(60)]


def test_every_id_lies_in_one_piece_and_sequences_have_no_gap(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(P, "RUN", 5000)
    rows = list(enumerate(texts()))
    found = P.packed(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2), PACKING_TOKENIZER).collect()
    whole, sequences = {}, {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.start == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id] += r.ids
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert whole == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    assert all(r.doc_tokens == len(whole[r.doc_id]) for r in found)
    padding = total = 0
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        size = sum(n for _, n in parts)
        assert size <= P.WINDOW
        total += size
        padding += 0 if size & (size - 1) == 0 else P.WINDOW - size
    # Two tasks may each end with a window that is not full.
    assert padding < 0.03 * total + 2 * P.WINDOW
    order = sorted(found, key=lambda r: (r.sequence_id, r.offset))
    firsts = [r.doc_id for r in order if r.start == 0]
    assert firsts == list(dict.fromkeys(r.doc_id for r in order))


def test_texts_that_spell_an_added_token_have_its_id(spark):
    plain = Tokenizer.from_file(PACKING_TOKENIZER)
    rows = list(enumerate(["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y.<|endoftext|><|endoftext|>\n z", "<|endoftext|", "<|endof text|>", "no such token " * 700 + "<|endoftext|> é"]))
    found = P.packed(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2), PACKING_TOKENIZER).collect()
    whole = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(whole.setdefault(r.doc_id, [])) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        whole[r.doc_id] += r.ids
    assert whole == {i: plain.encode(t, add_special_tokens=False).ids + [0] for i, t in rows}
    assert whole[0] == [64, 50256, 65, 0] and all(r.doc_tokens == len(whole[r.doc_id]) for r in found)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_with_added_tokens_the_ids_are_those_of_the_unchanged_tokenizer(pieces):
    text = "".join(pieces)
    assert ADDED([text])[0].tolist() == UNCHANGED.encode(text, add_special_tokens=False).ids


def test_no_rows_null_ids_and_extra_columns(spark):
    schema = "doc_id bigint, text string, ids int, start int"
    assert P.packed(spark.createDataFrame([], schema), PACKING_TOKENIZER).collect() == []
    found = P.packed(spark.createDataFrame([(None, "a", 1, 2), (None, "a", 1, 2)], schema).coalesce(1), PACKING_TOKENIZER, with_ids=False).collect()
    assert [(r.doc_id, r.start, r.length, r.offset) for r in found] == [(None, 0, 2, 0), (None, 0, 2, 2)]
