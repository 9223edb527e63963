"""Packing of documents into sequences by order-preserving dynamic programming.

Documents follow each other as one stream of token ids, each closed by id 0. The stream is cut into windows of at most
``WINDOW`` ids; a window is padded to ``WINDOW`` unless its length is a power of two. Among cuts at document ends, sentence
ends and every ``GRID`` ids, the program finds those with the smallest sum of padding, penalties for cuts inside documents
and sentences, and a little for each window. The best predecessor of a cut is the smallest value in a sliding range of
earlier cuts, which a monotone queue gives in constant time.
"""

import json
import zlib
from array import array
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.llm.frames import by_bytes, plain_caches
from skyseries.llm.token_counts import byte_symbols

WINDOW = 1024
GRID = 64
#: In units of one padding id: a cut at a sentence end, a cut inside a sentence, any window.
SENTENCE_CUT, INNER_CUT, PER_WINDOW = 2, 12, 8
#: Ids that are cut at a time. What follows the last windows of a run opens the next run.
RUN = 1 << 16
#: Encoded pieces of text that a Python worker remembers.
REMEMBERED = 500_000
_MARKS = ".,!?;:%&$#*|"

# White space other than a blank or a line end, and the mark that pieces are split at.
_OTHER_SPACE = ["\0", *(c for c in map(chr, range(1, 0x3001)) if c.isspace() and c not in " \n")]


def _wide(text: str) -> bool:
    """The tokenizer splits before a space, unless white space stands on both sides of it or ends the text with it."""
    return "  " in text or "\n \n" in text or text.endswith("\n ") or any(c in text for c in _OTHER_SPACE)


def _fast_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if the file's merges are in the order of its ids; ``tiktoken`` then gives the same ids."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary, symbols = model["vocab"], byte_symbols()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    single = [token for token in vocabulary if len(token) == 1 and token in symbols]
    if [vocabulary.get(m) for m in merged] != list(range(len(single), len(single) + len(merged))):
        return None
    return {bytes(symbols[c] for c in token): vocabulary[token] for token in (*single, *merged)}


class Encoder:
    """Ids of whole texts for a byte-level ``tokenizers`` file; pieces between single spaces are encoded once.

    Where the file allows it, new pieces are encoded by ``tiktoken`` from the file's own vocabulary: the same ids, several
    times as fast. With ``added``, texts that contain an added token of the file go through ``tokenizers`` as they are, so
    the token has its own id; without it, its characters are encoded like any others.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added else []
        self.whole = Tokenizer.from_file(path) if self.added else None
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, number in vocabulary.items():
            self.closing[number] = token[-1] in ".!?Ċ"
        ranks = _fast_ranks(path)
        if ranks is None:
            self.encode, encode_word = lambda text: tokenizer.encode(text, add_special_tokens=False).ids, None
        else:
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode, encode_word = fast.encode_ordinary, fast._encode_single_piece
        self.known = _Pieces(self.encode, encode_word)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, without special tokens."""
        known, out = self.known, []
        for text in texts:
            if any(token in text for token in self.added):
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            if _wide(text):
                out.append(np.array(self.encode(text), "<u4"))
                continue
            pieces = text.replace(" ", "\0 ").split("\0")
            out.append(np.frombuffer(b"".join([known[p] for p in pieces]), "<u4"))
            if len(known) > REMEMBERED:
                known.clear()
        return out


class _Pieces(dict):
    """The ids of pieces, as bytes, made when first asked for.

    The tokenizer's pattern splits letters, with their blank, from the marks behind them; both are merged without a
    pattern search, and words are remembered without their marks too.
    """

    def __init__(self, encode, encode_word):
        self.encode, self.encode_word = encode, encode_word
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def __missing__(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        ids = self.words.get(word)
        if ids is None:
            if self.encode_word is None or not word[1:].isalpha() or not (word[0] == " " or word[0].isalpha()):
                ids = self[piece] = array("I", self.encode(piece)).tobytes()
                return ids
            ids = self.words[word] = array("I", self.encode_word(word)).tobytes()
        marks = piece[len(word):]
        behind = self.marks.get(marks)
        if behind is None:
            behind = array("I", self.encode(marks)).tobytes()
            if len(self.marks) < 1000:
                self.marks[marks] = behind
        ids = self[piece] = ids + behind
        return ids

    def clear(self) -> None:
        super().clear()
        self.words.clear()


def _unpadded(places: np.ndarray, window: int) -> tuple[list[int], list[int]]:
    """For each place the earlier ones at a power of two below ``window``, the nearest first: offsets, and all in a row."""
    index = np.full(int(places[-1]) + 1, -1, np.int64)
    index[places] = np.arange(len(places))
    ends, begins = [], []
    for length in (1 << b for b in range(window.bit_length() - 1)):
        end = np.flatnonzero(places >= length)
        begin = index[places[end] - length]
        ends.append(end[begin >= 0])
        begins.append(begin[begin >= 0])
    end, begin = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(end, kind="stable")
    return np.searchsorted(end[order], np.arange(len(places) + 1)).tolist(), begin[order].tolist()


def best_cuts(places: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """Cuts of least cost through ``places`` (rising, from 0 to the end), as indices into it, both ends included.

    No two neighbouring places may be more than ``window`` apart; ``window`` is a power of two.
    """
    count = len(places)
    cost, back = [0] * count, [0] * count
    first, unpadded = _unpadded(np.array(places, np.int64), window)
    queue = deque([0])
    for j in range(1, count):
        p = places[j]
        while places[queue[0]] < p - window:
            queue.popleft()
        i = queue[0]
        least = cost[i] + places[i] + window - p
        for k in unpadded[first[j]: first[j + 1]]:
            if cost[k] < least:
                i, least = k, cost[k]
        cost[j], back[j] = least + penalties[j] + PER_WINDOW, i
        key = cost[j] + p
        while queue and cost[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    path = [count - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


class _Stream:
    """Pieces of documents that are not yet in a sequence."""

    def __init__(self, closing: np.ndarray, window: int, first: int, with_ids: bool):
        self.closing, self.window, self.sequence, self.with_ids = closing, window, first, with_ids
        self.docs, self.size = [], 0

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        self.docs.append((doc, start, ids, total))
        self.size += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of all sequences of the best cuts; unless ``last``, the two last windows stay for the next run."""
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        penalty = np.full(len(ids) + 1, -1, np.int8)
        penalty[::GRID] = INNER_CUT
        penalty[1:][self.closing[ids]] = SENTENCE_CUT
        penalty[ends] = penalty[0] = 0
        places = np.flatnonzero(penalty >= 0)
        found = places.tolist()
        cuts = [found[i] for i in best_cuts(found, penalty[places].tolist(), self.window)]
        if not last:
            cuts = cuts[:-2] if len(cuts) > 3 else cuts[:1]
        done, out = cuts[-1], []
        begin, doc = 0, 0
        for a, b in zip(cuts, cuts[1:]):
            at = a
            while at < b:
                while ends[doc] <= at:
                    begin, doc = int(ends[doc]), doc + 1
                to = min(b, int(ends[doc]))
                own = self.docs[doc]
                part = own[2][at - begin: to - begin]
                out.append((own[0], own[1] + at - begin, to - at, zlib.crc32(part.tobytes()), own[3], self.sequence, at - a, part if self.with_ids else None))
                at = to
            self.sequence += 1
        begin, rest = 0, []
        for own, end in zip(self.docs, ends.tolist()):
            if end > done:
                skip = max(0, done - begin)
                rest.append((own[0], own[1] + skip, own[2][skip:].copy(), own[3]))
            begin = end
        self.docs, self.size = rest, sum(len(d[2]) for d in rest)
        return out


_encoders: dict[str, Encoder] = {}

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: where it starts in its document and where it lies in which sequence.

    ``tokenizer`` is the path of a ``tokenizers`` file of a byte-level tokenizer, present on all executors. Every document
    is its ids and id 0; a null text is an empty one; rows with equal or null ids are documents of their own. Documents
    keep the order in which the tasks read them and are not shuffled; the last sequence of a task may be short.
    Ids are the tokenizer's own with ``add_special_tokens=False``: what a text spells as an added token is that token.
    ``ids_crc32`` is over little-endian 32-bit ids; ``with_ids`` adds the ids themselves. A task holds about ``RUN`` ids,
    or its longest document.
    """

    def pack(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer, added=True))
        stream = _Stream(encoder.closing, window, TaskContext.get().partitionId() << 40, with_ids)
        for batch in by_bytes(batches, text_col):
            with plain_caches():
                found = encoder([t or "" for t in batch.column(1).to_pylist()])
            for doc, ids in zip(batch.column(0).to_pylist(), found):
                stream.add(doc, 0, np.append(ids, np.uint32(0)), len(ids) + 1)
                if stream.size >= RUN:
                    yield _pieces(stream.cut(last=False), with_ids)
        if stream.docs:
            yield _pieces(stream.cut(last=True), with_ids)

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(pack, PIECES + (", ids array<bigint>" if with_ids else ""))


def _pieces(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = [part.split()[0] for part in PIECES.split(", ")]
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
    if with_ids:
        columns.append(pa.array([r[-1].astype(np.int64) for r in rows], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)
