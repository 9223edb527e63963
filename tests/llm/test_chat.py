"""Chat formatting: exact round trip, also over the ends of batches."""

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from skyseries.llm import chat as C

HARD = st.text(st.sampled_from("\\<>/nturé漢\n "), max_size=12) | st.sampled_from(["</turn>", "<turn>user\n", "\\### Assistant: </turn> ok", "\\\\<"])


@given(st.lists(st.tuples(HARD, HARD), max_size=6))
def test_what_is_assembled_reads_back(turns):
    buffer, begin, text_begin, size = C.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()))
    raw = buffer.tobytes()
    assert C.read_back(raw) == [(r.encode(), t.encode()) for r, t in turns]
    assert [C.unescaped(raw[a: a + n]).decode() for a, n in zip(text_begin, size)] == [t for _, t in turns]
    assert begin[-1] == len(raw)


@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from(["assistant", "user"]), HARD), max_size=14), st.integers(1, 4))
def test_conversations_over_the_ends_of_batches(turns, size):
    turns.sort(key=lambda t: t[0])
    columns = [pa.array([t[i] for t in turns], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["conv_id", "role", "text"])
    found = [r for out in C._assembled(batch.slice(a, size) for a in range(0, len(turns), size)) for r in out.to_pylist()]
    assert [r["conv_id"] for r in found] == sorted({t[0] for t in turns})
    for r in found:
        own, raw = [t for t in turns if t[0] == r["conv_id"]], r["formatted"].encode()
        assert C.read_back(raw) == [(role.encode(), text.encode()) for _, role, text in own]
        spans = [C.unescaped(raw[s["start"]: s["start"] + s["length"]]).decode() for s in r["loss_spans"]]
        assert spans == [text for _, role, text in own if role == "assistant"]


def test_nulls_ties_repeated_rows_and_extra_columns(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "a", 0), (1, 1, "assistant", "a", 0), (2, None, None, "x\n", 0), (None, 0, "user", "n", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, formatted int").repartition(3)
    found = {r.conv_id: r for r in C.formatted(df).collect()}
    turn = "<turn>{}\n{}</turn>\n".format
    assert found[1].formatted == turn("user", "") + turn("assistant", "a") * 2 + turn("assistant", "b")
    assert found[2].formatted == turn("", "x\n") and found[2].loss_spans == []
    assert found[None].formatted == turn("user", "n")
    assert C.digests(C.formatted(df.limit(0))).collect() == []
    by_id = {r.conv_id: r for r in C.digests(C.formatted(df)).collect()}
    assert (by_id[1].n_turns, by_id[1].loss_chars, by_id[1].formatted_chars) == (4, 3, len(found[1].formatted))


def test_a_conversation_beyond_one_value_is_named(monkeypatch):
    import pyarrow as pa
    import pytest

    monkeypatch.setattr(C, "LARGEST", 60)
    batch = pa.RecordBatch.from_pydict({"conv_id": [4, 4, 5], "role": ["user"] * 3, "text": ["x" * 40, "y" * 40, "z"]})
    with pytest.raises(ValueError, match="conversation 4 "):
        list(C._assembled(iter([batch])))
