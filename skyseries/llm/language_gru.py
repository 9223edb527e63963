"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read as UTF-8 bytes in windows of ``WINDOW``. One recurrent network passes each window forwards, one backwards;
both states at a position together label it, so every position has seen its whole window. A document's probabilities are
the mean of those of all its positions.

Training is backpropagation through time on windows of a bounded sample of labelled documents: each position is an example
of its document's language. Steps follow Adam. Words that all languages share stay undecided at their positions and so
weigh little where they occur.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyseries.llm.frames import by_bytes
from skyseries.llm.words import utf8

#: Bytes of a window, units of each direction.
WINDOW, UNITS = 96, 16
#: For fitting: at most so many languages (the most frequent), documents of each, and characters of each document.
LANGUAGES, TRAIN_DOCS, TRAIN_CHARS = 64, 400, 4 * WINDOW
STEPS, BATCH, RATE = 260, 128, 0.012
#: What is predicted where no letter is.
NONE = "und"
#: Windows that go through the network at a time.
TOGETHER = 1024

# Rows of the gates in all tables: reset, update, candidate.
_F32 = np.float32


def _sigmoid(x):
    x *= _F32(0.5)
    np.tanh(x, out=x)
    x *= _F32(0.5)
    x += _F32(0.5)
    return x


@dataclass
class Direction:
    """A gated recurrent network: ``table`` holds what each byte adds to the gates, ``state`` what each unit adds."""

    table: np.ndarray
    state: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, rng, units=UNITS):
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(units)).astype(_F32)
        return cls(draw(256, 3 * units), draw(units, 3 * units), np.zeros(units, _F32))

    def forward(self, codes: np.ndarray, keep: bool = False):
        """States (time, windows, units) for codes (time, windows); with ``keep`` also what the way back needs."""
        if not keep:
            return self._read(codes)
        length, n = codes.shape
        units = len(self.bias)
        out = np.empty((length, n, units), self.table.dtype)
        h, kept = np.zeros((n, units), self.table.dtype), []
        for t in range(length):
            x = self.table.take(codes[t], axis=0)
            own = h @ self.state
            gates = _sigmoid(x[:, : 2 * units] + own[:, : 2 * units])
            reset, update = gates[:, :units], gates[:, units:]
            inner = own[:, 2 * units:] + self.bias
            new = np.tanh(x[:, 2 * units:] + reset * inner)
            out[t] = new + update * (h - new)
            kept.append((h, reset, update, inner, new))
            h = out[t]
        return out, kept

    def _states(self, codes: np.ndarray) -> np.ndarray:
        """The states alone, the same numbers as in fitting."""
        return self.forward(codes, keep=True)[0]

    def _read(self, codes: np.ndarray) -> np.ndarray:
        """The states alone, as those of fitting but for rounding, by passes over whole arrays.

        A gate is 1 / (1 + exp(-x)) and is never made: what it would multiply is divided by 1 + exp(-x). The candidate
        tanh(x) is 1 - 2 / (1 + exp(2 x)), as an exponential costs half as much as a tanh. Beyond the range of the numbers
        both come out as their limits.
        """
        (length, n), units, kind = codes.shape, len(self.bias), self.table.dtype
        # Signs and doubling are exact. Tables and products of one gate each, so that no pass has gaps.
        scale = np.repeat(np.array([-1, -1, 2], kind), units)
        tables = [np.ascontiguousarray(a) for a in np.split(self.table * scale, 3, axis=1)]
        state = np.ascontiguousarray((self.state * scale).reshape(units, 3, units).transpose(1, 0, 2))
        bias, codes = np.tile(2 * self.bias, (n, 1)), codes.astype(np.intp)
        out, own, gates = np.empty((length, n, units), kind), np.empty((3, n, units), kind), np.empty((2, n, units), kind)
        h, new, inner = np.zeros((n, units), kind), np.empty((n, units), kind), own[2]
        with np.errstate(over="ignore"):
            for t in range(length):
                np.matmul(h, state, out=own)
                for table, gate in zip(tables, gates):
                    table.take(codes[t], axis=0, out=gate, mode="clip")
                gates += own[:2]
                np.exp(gates, out=gates)
                gates += 1
                inner += bias
                inner /= gates[0]
                tables[2].take(codes[t], axis=0, out=new, mode="clip")
                new += inner
                np.exp(new, out=new)
                new += 1
                np.divide(-2, new, out=new)
                new += 1
                np.subtract(h, new, out=inner)
                inner /= gates[1]
                h = np.add(new, inner, out=out[t])
        return out

    def backward(self, codes, kept, d_out):
        """Gradients of the three arrays, from those of the states."""
        units = len(self.bias)
        d_table, d_state, d_bias = np.zeros_like(self.table), np.zeros_like(self.state), np.zeros_like(self.bias)
        d_h = np.zeros_like(d_out[0])
        into = np.empty((len(codes), *d_out.shape[1:2], 3 * units), self.table.dtype)
        for t in range(len(codes) - 1, -1, -1):
            h, reset, update, inner, new = kept[t]
            d_h = d_h + d_out[t]
            d_new = d_h * (1 - update) * (1 - new * new)
            d_update = d_h * (h - new) * update * (1 - update)
            d_reset = d_new * inner * reset * (1 - reset)
            d_inner = d_new * reset
            d_own = np.concatenate((d_reset, d_update, d_inner), axis=1)
            into[t] = np.concatenate((d_reset, d_update, d_new), axis=1)
            d_state += h.T @ d_own
            d_bias += d_inner.sum(axis=0)
            d_h = d_h * update + d_own @ self.state.T
        flat, rows = codes.ravel(), into.reshape(-1, 3 * units)
        order = np.argsort(flat, kind="stable")
        found, first = np.unique(flat[order], return_index=True)
        d_table[found] = np.add.reduceat(rows[order], first, axis=0)
        return [d_table, d_state, d_bias]


def _mirrored(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Codes (time, windows) from the last byte of each window to the first; what lies beyond stays zero."""
    at = sizes[None, :] - 1 - np.arange(len(codes))[:, None]
    return np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), axis=0), 0)


def _softmax(x):
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Network:
    """Both directions and the layer that labels a position: one weight for each unit and language."""

    languages: list[str]
    ahead: Direction
    back: Direction
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages, rng, units=UNITS):
        weights = (rng.normal(size=(2 * units, len(languages))) / np.sqrt(2 * units)).astype(_F32)
        return cls(languages, Direction.new(rng, units), Direction.new(rng, units), weights, np.zeros(len(languages), _F32))

    def arrays(self) -> list[np.ndarray]:
        return [x for d in (self.ahead, self.back) for x in (d.table, d.state, d.bias)] + [self.weights, self.bias]

    def _turned(self, states, sizes):
        """States of the way back at the positions they stand for."""
        at = sizes[None, :] - 1 - np.arange(len(states))[:, None]
        return np.take_along_axis(states, np.maximum(at, 0)[:, :, None], axis=0)

    def probabilities(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(time, windows, languages); positions beyond a window's size hold nothing of use."""
        full = (sizes == len(codes)).all()
        ahead = self.ahead.forward(codes)
        back = self.back.forward(codes[::-1] if full else _mirrored(codes, sizes))
        back = back[::-1] if full else self._turned(back, sizes)
        units = ahead.shape[2]
        # One row for each language, so that all passes run along the positions.
        scores = self.weights[:units].T @ ahead.reshape(-1, units).T
        scores += self.weights[units:].T @ back.reshape(-1, units).T
        scores += self.bias[:, None]
        scores -= scores.max(axis=0)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=0)
        return scores.reshape(-1, *ahead.shape[:2]).transpose(1, 2, 0)

    def gradients(self, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        """Mean loss of all positions and its gradients, in the order of ``arrays``."""
        mirrored = _mirrored(codes, sizes)
        (ahead, kept_ahead), (back, kept_back) = self.ahead.forward(codes, keep=True), self.back.forward(mirrored, keep=True)
        both = np.concatenate((ahead, self._turned(back, sizes)), axis=2)
        found = _softmax(both @ self.weights + self.bias)
        inside = np.arange(len(codes))[:, None] < sizes[None, :]
        total = inside.sum()
        own = np.take_along_axis(found, np.broadcast_to(labels[None, :, None], (*codes.shape, 1)), axis=2)[:, :, 0]
        loss = -(np.log(np.maximum(own, 1e-9)) * inside).sum() / total
        d = found.copy()
        np.put_along_axis(d, np.broadcast_to(labels[None, :, None], (*codes.shape, 1)), (own - 1)[:, :, None], axis=2)
        d *= (inside / total)[:, :, None].astype(d.dtype)
        flat = d.reshape(-1, d.shape[2])
        d_weights, d_bias = both.reshape(-1, both.shape[2]).T @ flat, flat.sum(axis=0)
        d_both = d @ self.weights.T
        units = ahead.shape[2]
        d_back = self._turned(d_both[:, :, units:] * inside[:, :, None], sizes) * inside[:, :, None]
        return loss, [
            *self.ahead.backward(codes, kept_ahead, d_both[:, :, :units] * inside[:, :, None]),
            *self.back.backward(mirrored, kept_back, d_back), d_weights, d_bias,
        ]


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, size) of the windows that cover all texts; sizes of one text differ by one at most."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    base, extra = sizes // np.maximum(counts, 1), sizes % np.maximum(counts, 1)
    first = offsets[owner] + place * base[owner] + np.minimum(place, extra[owner])
    return owner, first, base[owner] + (place < extra[owner])


def _codes(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = first[None, :] + np.arange(int(sizes.max()))[:, None]
    inside = np.arange(len(at))[:, None] < sizes[None, :]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0)


def fit(rows: list[tuple[str, str]], steps: int = STEPS, units: int = UNITS) -> Network | None:
    """A network from (text, language) rows; nothing without rows. Every language weighs the same."""
    languages = sorted({language for _, language in rows})
    if not languages:
        return None
    rng = np.random.default_rng(11)
    network = Network.new(languages, rng, units)
    offsets, data = utf8(pa.array([text for text, _ in rows], pa.string()))
    owner, first, sizes = windows_of(offsets)
    if len(languages) == 1 or not len(owner):
        return network
    labels = np.array([languages.index(language) for _, language in rows])[owner]
    share = 1 / np.bincount(labels, minlength=len(languages))[labels]
    share /= share.sum()
    means, squares = [np.zeros_like(a) for a in network.arrays()], [np.zeros_like(a) for a in network.arrays()]
    for step in range(1, steps + 1):
        picked = rng.choice(len(owner), BATCH, p=share)
        _, found = network.gradients(_codes(data, first[picked], sizes[picked]), sizes[picked], labels[picked])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found))
        # Slow at first and at the end.
        rate = RATE * min(1, step / 20) * (1 - 0.9 * step / steps)
        for array, gradient, mean, square in zip(network.arrays(), found, means, squares):
            gradient = gradient * min(1, 1 / norm)
            mean += 0.1 * (gradient - mean)
            square += 0.01 * (gradient * gradient - square)
            array -= (rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)).astype(_F32)
    return network


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Predictor:
    def __init__(self, network: Network | None):
        self.network = network

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """(texts, languages): the mean over the positions of each whole text; zero for empty ones."""
        offsets, data = utf8(texts)
        owner, first, sizes = windows_of(offsets)
        out = np.zeros((len(texts), len(self.network.languages)))
        order = np.argsort(-sizes, kind="stable")
        for a in range(0, len(order), TOGETHER):
            part = order[a: a + TOGETHER]
            own = sizes[part]
            found = self.network.probabilities(_codes(data, first[part], own), own)
            if own[-1] < len(found):
                found *= (np.arange(len(found))[:, None] < own[None, :])[:, :, None]
            np.add.at(out, owner[part], found.sum(axis=0, dtype=np.float64))
        return out / np.maximum(np.diff(offsets), 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability; ``und`` and 0 for texts that are null or hold no letter."""
        letters = [t is not None and has_letter(t) for t in texts.to_pylist()]
        if self.network is None:
            return [NONE] * len(letters), np.zeros(len(letters))
        found = self.probabilities(texts)
        best = found.argmax(axis=1)
        names = [self.network.languages[k] if known else NONE for k, known in zip(best, letters)]
        return names, np.where(letters, np.minimum(found.max(axis=1), 1.0), 0.0)


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network | None:
    """A network from the documents outside the held-out third that have an id, a language and a text.

    A bounded sample is fitted on the driver: of each of the ``LANGUAGES`` most frequent languages ``train_docs`` distinct
    texts with the smallest hash, and of a longer text ``TRAIN_CHARS`` characters from a place that its hash names.
    """
    known = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col("lang").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    hashed = known.select("lang", "text", F.xxhash64("text").alias("key"))
    counts = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("key").alias("texts"))
    counts = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return fit([])
    # About four times as many as are wanted pass, whatever the size of the table; copies have one key.
    limit = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * train_docs / max(1, r["texts"])))])
    drawn = hashed.where(F.pmod("key", F.lit(1 << 40)) < F.coalesce(limit[F.col("lang")], F.lit(0.0)) * float(1 << 40))
    room = F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1
    part = F.col("text").substr((F.pmod(F.shiftright("key", 40), room) + 1).cast("int"), F.lit(TRAIN_CHARS))
    drawn = drawn.select("lang", F.pmod("key", F.lit(1 << 40)).alias("rank"), "key", part.alias("part")).groupBy("lang", "rank", "key").agg(F.min("part").alias("part"))
    first = Window.partitionBy("lang").orderBy("rank", "key")
    rows = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= train_docs).select("lang", "n", "part").toArrow()
    rows = sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "n", "part"))))
    return fit([(part, language) for language, _, part in rows])


def predicted(docs: DataFrame, network: Network | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of each whole text and its probability; all rows and columns stay, ``names`` are new.

    ``und`` and 0 where the text is null or has no letter, or where nothing was learned. Only the text is looked at. No
    shuffle; a batch holds about a megabyte of text.
    """
    def label(batches):
        predictor = Predictor(network)
        for batch in by_bytes(batches, text_col):
            languages, scores = predictor.predict(batch.column(text_col))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(label, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
