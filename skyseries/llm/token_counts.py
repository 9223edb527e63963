"""Token counts by a linear longest-match automaton.

A word is cut greedily: always the longest vocabulary piece that starts where the last one ended. The automaton is the
trie of the vocabulary with a failure link for each node: where the walk goes on once the node's pieces are cut off. How
many pieces that are is computed beforehand, so a word is counted in time linear in its length and no piece is built.
"""

import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyseries.llm.frames import by_bytes

#: Added to the last byte of a word: it is another symbol there than inside a word.
LAST = 256
#: Words that a Python worker remembers.
REMEMBERED = 500_000
# Runs of letters, single digits, and runs of other characters are words.
_PARTS = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: themselves where printable, then 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def word_end_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a ``tokenizers`` file with word ends, as symbols; special tokens are left out."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"] for t in model.get("added_tokens", ())}
    symbols, pieces = byte_symbols(), []
    for token in model["model"]["vocab"]:
        if token not in special:
            word = token.removesuffix("</w>")
            values = [symbols[c] for c in word]
            pieces.append(tuple(values[:-1]) + (values[-1] + LAST * (word != token),))
    return pieces


class LongestMatch:
    """``count`` gives the number of greedy pieces of a symbol sequence, or None if some part matches no piece."""

    def __init__(self, pieces):
        self.step: dict[int, int] = {}
        children: list[list[int]] = [[]]
        ends, symbol_of, parent = {0: False}, [0], [0]
        for piece in pieces:
            node = 0
            for symbol in piece:
                after = self.step.get(node << 9 | symbol)
                if after is None:
                    after = len(children)
                    self.step[node << 9 | symbol] = after
                    children.append([])
                    children[node].append(after)
                    symbol_of.append(symbol)
                    parent.append(node)
                node = after
            if node:
                ends[node] = True
        #: Failure links (-1: nowhere) and the pieces popped on the way along them.
        self.fail, self.popped = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            level = [child for node in level for child in children[node]]
            for node in level:
                if ends.get(node):
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                above, symbol = parent[node], symbol_of[node]
                at, popped = self.fail[above], self.popped[above]
                while at >= 0 and (at << 9 | symbol) not in self.step:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.step[at << 9 | symbol], popped

    def count(self, symbols) -> int | None:
        step, fail, popped, node, total = self.step, self.fail, self.popped, 0, 0
        for symbol in symbols:
            while (after := step.get(node << 9 | symbol)) is None:
                if fail[node] < 0:
                    return None
                total += popped[node]
                node = fail[node]
            node = after
        while node:
            if fail[node] < 0:
                return None
            total += popped[node]
            node = fail[node]
        return total


def parts(chunk: str) -> list[str]:
    return _PARTS.findall(chunk.lower())


def word_symbols(word: str) -> tuple[int, ...]:
    *inner, last = word.encode()
    return (*inner, last + LAST)


_automata: dict[str, LongestMatch] = {}


def counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) of every whole text.

    ``vocabulary`` is the path of a vocabulary file with word ends, present on all executors. Texts are lower-cased and
    white space is dropped. A word that the vocabulary cannot cover is one token and counts as unknown. Null and empty
    texts have no words; rows are independent, repeated or not. No shuffle.
    """

    def counted(batches):
        automaton = _automata.get(vocabulary) or _automata.setdefault(vocabulary, LongestMatch(word_end_vocabulary(vocabulary)))
        known: dict[str, tuple[int, int, int]] = {}
        for batch in by_bytes(batches, text_col):
            rows = []
            for text in batch.column(1).to_pylist():
                chunks = (text or "").split()
                for chunk in set(chunks).difference(known):
                    found = [automaton.count(word_symbols(part)) for part in parts(chunk)]
                    known[chunk] = (len(found), sum(1 if n is None else n for n in found), found.count(None))
                got = [known[c] for c in chunks]
                rows.append([sum(x) for x in zip(*got)] if got else [0, 0, 0])
                if len(known) > REMEMBERED:
                    known.clear()
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col)
    return rows.mapInArrow(counted, f"`{id_col}` bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
