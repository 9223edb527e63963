"""Chat formatting by columnar byte assembly.

A turn becomes ``<turn>`` role newline text ``</turn>`` newline. Inside role and text a backslash comes before every
``\\`` and ``<``, and a role's newline is written ``\\n``, so no text can contain a mark and reading back is exact.

A batch of turns is one preallocated byte buffer: segment lengths, their running sums and scatter positions are computed
in numpy, then marks, roles, texts and escapes are copied to their places. Conversations are slices of that buffer.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.llm.frames import by_bytes
from skyseries.llm.words import utf8

OPEN, CLOSE = b"<turn>", b"</turn>\n"
#: Bytes that one value can hold.
LARGEST = 2**31 - 1
LEARNED = "assistant"

_ESCAPED = np.zeros(256, bool)
_ESCAPED[[ord("\\"), ord("<")]] = True
_TURN = re.compile(rb"<turn>((?:[^\\<\n]++|\\.)*+)\n((?:[^\\<]++|\\.)*+)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(rb"\\(.)", re.DOTALL)

FORMATTED = "conv_id bigint, formatted string, loss_spans array<struct<start:bigint,length:bigint>>"


def _scatter(buffer: np.ndarray, starts: np.ndarray, offsets: np.ndarray, data: np.ndarray, escaped: np.ndarray, before: np.ndarray) -> None:
    """Copy segment i of ``data`` to ``starts[i]``, each escaped byte behind a backslash. ``before``: escapes up to a byte."""
    sizes = np.diff(offsets)
    place = np.arange(len(data)) + before[:-1] + np.repeat(starts - offsets[:-1] - before[offsets[:-1]], sizes)
    buffer[place[escaped]] = ord("\\")
    buffer[place + escaped] = data


def assemble(roles, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns, where each turn begins (and the end), and begin and length of each escaped text."""
    role_at, role = utf8(roles)
    text_at, text = utf8(texts)
    role = role.copy()
    role_escape, text_escape = _ESCAPED[role] | (role == 10), _ESCAPED[text]
    role[role == 10] = ord("n")
    role_before, text_before = (np.concatenate(([0], np.cumsum(e))) for e in (role_escape, text_escape))
    role_size = np.diff(role_at + role_before[role_at])
    text_size = np.diff(text_at + text_before[text_at])
    begin = np.concatenate(([0], np.cumsum(role_size + text_size + len(OPEN) + 1 + len(CLOSE))))
    buffer = np.empty(begin[-1], np.uint8)
    buffer[begin[:-1, None] + np.arange(len(OPEN))] = np.frombuffer(OPEN, np.uint8)
    role_begin = begin[:-1] + len(OPEN)
    _scatter(buffer, role_begin, role_at, role, role_escape, role_before)
    buffer[role_begin + role_size] = 10
    text_begin = role_begin + role_size + 1
    _scatter(buffer, text_begin, text_at, text, text_escape, text_before)
    buffer[(text_begin + text_size)[:, None] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, np.uint8)
    return buffer, begin, text_begin, text_size


def _rows(ids: list, buffer, offsets: np.ndarray, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
    if len(ids) and int(offsets[-1]) > LARGEST:
        raise ValueError(f"conversation {ids[int(np.diff(offsets).argmax())]} has more than {LARGEST} bytes when formatted")
    texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)).cast(pa.string())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    spans = pa.array([[{"start": int(a), "length": int(n)} for a, n in own] for own in spans], kind)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), texts, spans], names=["conv_id", "formatted", "loss_spans"])


def _assembled(batches):
    """Turns in order of their conversations; a conversation that goes on in the next batch waits for it."""
    waiting, parts, held, spans = None, [], 0, []
    for batch in by_bytes(batches, "text"):
        ids, learned = batch.column("conv_id").to_pylist(), [r == LEARNED for r in batch.column("role").to_pylist()]
        buffer, begin, text_begin, text_size = assemble(batch.column("role"), batch.column("text"))
        heads = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]] + [len(ids)]
        own = [[(text_begin[t] - begin[a], text_size[t]) for t in range(a, b) if learned[t]] for a, b in zip(heads, heads[1:])]
        first = 0
        if parts and ids[0] == waiting[0]:
            first = 1
            parts.append(buffer[: begin[heads[1]]])
            spans += [(a + held, n) for a, n in own[0]]
            held += int(begin[heads[1]])
        done = len(heads) - 2
        if parts and (first == 0 or done > 0):
            yield _rows([waiting[0]], np.concatenate(parts), np.array([0, held]), [spans])
            parts = []
        if done > first:
            cuts = begin[heads[first: done + 1]]
            yield _rows([ids[h] for h in heads[first:done]], buffer[cuts[0]: cuts[-1]], cuts - cuts[0], own[first:done])
        if done >= first:
            last = heads[done]
            waiting, parts, spans, held = (ids[last],), [buffer[begin[last]:].copy()], own[done], int(begin[-1] - begin[last])
    if parts:
        yield _rows([waiting[0]], np.concatenate(parts), np.array([0, held]), [spans])


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text); other columns are not read.

    ``loss_spans`` are begin and length, in UTF-8 bytes of ``formatted``, of each assistant text as it stands there. Null
    roles and texts are empty, turns with equal numbers come in order of role and text, repeated rows stay, rows without
    conv_id are one conversation. One shuffle by conversation; tasks read their sorted turns as a stream, holding about a
    megabyte and one conversation's text. A conversation that no single value can hold (over 2 GB) is an error that names
    it.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select(F.col("conv_id").cast("bigint").alias("conv_id"), "role", "text").mapInArrow(_assembled, FORMATTED)


def unescaped(part: bytes) -> bytes:
    return _ESCAPE.sub(lambda m: b"\n" if m[1] == b"n" else m[1], part)


def read_back(text: bytes) -> list[tuple[bytes, bytes]]:
    """Role and text of each turn; fails if ``text`` is anything but turns."""
    out, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, text under the loss mask, size."""

    def digested(batches):
        for batch in by_bytes(batches, "formatted"):
            rows = []
            for conv, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                turns = read_back(raw)
                whole = b"".join(role + b"\n" + said + b"\n" for role, said in turns)
                learned = b"".join(unescaped(raw[s["start"]: s["start"] + s["length"]]) for s in spans)
                rows.append((conv, len(turns), hashlib.sha256(whole).hexdigest(), len(learned.decode()), hashlib.sha256(learned).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return chats.mapInArrow(digested, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
