"""Words and their hashes against plain Python."""

import re

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from skyseries.llm import words as W

TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbß é\t\n\x0b\x0c\r. "), max_size=12)), max_size=6)


@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    offsets, data = W.utf8(pa.array(texts, pa.string()))
    found = W.Words(offsets, data)
    raw = data.tobytes()
    for i, text in enumerate(texts):
        own = [raw[a:b].decode() for a, b in zip(found.start[found.first[i]: found.first[i + 1]], found.end[found.first[i]: found.first[i + 1]])]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(st.lists(st.text(st.sampled_from("aAbBéÉ"), min_size=1, max_size=5), min_size=1, max_size=8))
def test_hashes_tell_words_apart(words):
    for lower in (True, False):
        same = [re.sub("[A-Z]", lambda m: m[0].lower(), w) if lower else w for w in words]
        hashes = W.Words(*W.utf8(pa.array([" ".join(words)]))).hashes(lower).tolist()
        assert [same.index(w) for w in same] == [hashes.index(h) for h in hashes]


def test_a_slice_of_a_column_and_an_empty_one():
    column = pa.array(["a b", None, "c"]).slice(1)
    assert W.Words(*W.utf8(column)).first.tolist() == [0, 0, 1]
    assert len(W.Words(*W.utf8(pa.array([], pa.string()))).start) == 0
