"""Quality rules by repetition coverage: how much of a text lies inside repeated word runs and repeated lines.

The hashes of all runs come from one running sum over the words of a batch: a run of any length is the difference of two
sums, rolled back to its place. Long runs are measured by all that repeat, short ones by the most frequent.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyseries.llm import words as W
from skyseries.llm.frames import by_bytes, free_name

#: Largest share of a text's word characters inside n-word runs that occur twice or more, the first included.
RUN_LIMITS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share that the most frequent n-word run makes up, times the runs there are of it; one that comes twice is no sign.
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
TOP_TIMES = 3
#: Largest share of its word characters in lines equal to an earlier line.
LINE_LIMIT = 0.20
MIN_WORDS = 10
#: The base rule: percent of the words that may lie in repeated windows of five.
REPEAT_PERCENT = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = T.StructType(
    [T.StructField(c, T.LongType(), False) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(f"top{n}_chars", T.LongType(), False) for n in TOP_LIMITS]
    + [T.StructField(f"run{n}_chars", T.LongType(), False) for n in RUN_LIMITS]
    + [T.StructField("dup_line_chars", T.LongType(), False)]
    + [T.StructField(c, T.BooleanType(), False) for c in ("base_failed", "kept")]
)


def rolled(hashes: np.ndarray, sizes) -> dict[int, np.ndarray]:
    """A hash for each run of each of ``sizes`` words, in order; runs may go over the end of a text."""
    up, down = W.powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return {n: W.mix((sums[n:] - sums[:-n]) * down[: max(0, len(hashes) + 1 - n)], n) if len(hashes) >= n else np.empty(0, np.uint64) for n in sizes}


def _covered(runs: np.ndarray, size: int) -> np.ndarray | None:
    """For each word of one text: does it lie in a run of ``size`` words that the text holds twice or more?"""
    if len(runs) < 2:
        return None
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return None
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(runs) + size, np.int64)
    np.add.at(change, np.flatnonzero(twice), 1)
    np.add.at(change, np.flatnonzero(twice) + size, -1)
    return np.cumsum(change[:-1]) > 0


def _top(runs: np.ndarray, size: int, chars: np.ndarray) -> int:
    """Characters of the run that makes up most, times its number; 0 if none comes ``TOP_TIMES``. ``chars``: running sum."""
    if len(runs) < TOP_TIMES:
        return 0
    order = np.argsort(runs, kind="stable")
    ordered = runs[order]
    if not (ordered[TOP_TIMES - 1:] == ordered[: len(runs) - TOP_TIMES + 1]).any():
        return 0
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    times = np.diff(np.append(first, len(runs)))
    at = order[first]
    return int((times * (chars[at + size] - chars[at]))[times >= TOP_TIMES].max(initial=0))


def measure(texts) -> list[tuple]:
    """One tuple in the order of MEASURES for each text of a string column."""
    offsets, data = W.utf8(texts)
    found = W.Words(offsets, data)
    hashes = found.hashes(lower=False)
    points = (data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(points & found.inside)))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    word_chars = chars[found.end] - chars[found.start]
    before = np.concatenate(([0], np.cumsum(word_chars)))
    runs = rolled(hashes, (*TOP_LIMITS, *RUN_LIMITS))
    limits = [*TOP_LIMITS.values(), *RUN_LIMITS.values(), LINE_LIMIT]
    out = []
    for i in range(len(offsets) - 1):
        a, b = found.first[i], found.first[i + 1]
        n, sizes = int(b - a), word_chars[a:b]
        total = int(sizes.sum())
        # Runs within this text; those over its end belong to no text.
        own = {size: all_runs[a: max(a, b - size + 1)] for size, all_runs in runs.items()}
        covered = [_top(own[size], size, before[a: b + 1]) for size in TOP_LIMITS]
        repeated, shorter = 0, True
        for size in RUN_LIMITS:
            # A repeated run of n + 1 words holds a repeated run of n words.
            inside = _covered(own[size], size) if shorter else None
            shorter = inside is not None
            covered.append(int(sizes[inside].sum()) if shorter else 0)
            if size == 5 and shorter:
                repeated = int(inside.sum())
        lines, seen, doubled, doubled_chars = data[offsets[i]: offsets[i + 1]].tobytes().split(b"\n"), set(), 0, 0
        if len(lines) > 1:
            for line in lines:
                if line in seen:
                    kept = b"".join(line.split())
                    if kept:
                        doubled += 1
                        doubled_chars += len(kept.decode("utf-8"))
                else:
                    seen.add(line)
        covered.append(doubled_chars)
        failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
        good = not failed and all(c <= most * total for c, most in zip(covered, limits))
        out.append((n, total, int(symbols[offsets[i + 1]] - symbols[offsets[i]]), doubled, repeated, *covered, failed, good))
    return out


def with_quality(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column of the measures above; every row and column stays.

    Counts are over whole texts. A null or empty text has no words and fails; ties and repeated rows are rows of their
    own. ``name`` is no column of ``docs`` (see ``free_name``). No shuffle; a task holds about a megabyte of text at a
    time, or its longest text.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(name, MEASURES, False)])

    def measured(batches):
        kind = pa.struct([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in MEASURES.fields])
        for batch in by_bytes(batches, text_col):
            rows = [dict(zip(MEASURES.names, row)) for row in measure(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, name])

    return docs.mapInArrow(measured, schema)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and measures alone; the scan reads only these two columns."""
    return with_quality(docs.select(id_col, text_col), "_quality", text_col).select(id_col, "_quality.*")


def kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    name = free_name(docs, "_quality")
    return with_quality(docs, name, text_col).where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_()}
