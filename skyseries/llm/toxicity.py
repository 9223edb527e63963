"""Toxicity by a string-kernel support vector machine with Nystroem landmarks.

The kernel of two words is the inner product of their subsequences of three and four characters, gaps allowed: one that
spans s characters counts ``DECAY`` to the power of the characters it skips, up to ``GAP`` of them. A word with an inserted
or left-out character so stays near the word itself. Words are compared with ``LANDMARKS`` landmark words; an SVM with
squared hinge loss is fitted in the space they span (Nystroem). As the decision is linear in the subsequences, its sum
over landmarks is folded into one weight per subsequence, and scoring a word is a handful of table look-ups in numpy.

Labels are on documents, so training goes by sentences: a sentence of a labelled document carries its label, sentences
that both classes share carry the clean one, and each counts once however many copies there are. Words that stand in
several toxic sentences and hardly in clean ones are toxic examples; words of clean documents are clean ones, first a
sample of all, then those that the machine takes for toxic. A second part of the documents, not used for words, fits the
logistic step from a document's most toxic words to its score.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyseries.llm.frames import by_bytes, give_back
from skyseries.llm.words import Words, mix, utf8, windows

#: At most so many labelled documents of each class are used for fitting, those with the smallest hash of their id ...
TRAIN_DOCS = 3000
#: ... and of them those up to this many characters. Scores are of whole texts of any length.
TRAIN_CHARS = 12_000
LANDMARKS = 300
DECAY, GAP = 0.5, 2
#: Toxic words stand in so many toxic sentences at least, and at least this share of their sentences are toxic.
MIN_SENTENCES, MIN_SHARE = 3, 0.9
#: Copies of a toxic word, each with another character put in, that are learned too.
VARIANTS = 3
CLEAN_WORDS = 5000
ROUNDS = 4
#: Longer words are covered by overlapping pieces of this length.
PIECE = 22
#: Neighbouring words of so many characters at most are also read as one word, if one of them has so few ...
SHORT, SHORTEST = 4, 3
#: ... and all of them together are as long as this.
JOINED = (4, 12)
#: Decisions below count as this.
FLOOR = -0.3
#: Words that a Python worker remembers, and those that the driver does while it fits.
REMEMBERED, REMEMBERED_FITTING = 1_000_000, 200_000
#: Words whose subsequences are held at a time, and texts that the driver looks at together.
WORDS_AT_ONCE, TEXTS_AT_ONCE = 1024, 16

_BITS = 21
_FACTORS = mix(np.arange(4, dtype=np.uint64), 5) | np.uint64(1)


def _patterns() -> list[tuple[tuple[int, ...], float]]:
    out = []
    for size in (3, 4):
        last = size - 1 + GAP
        def grow(picked):
            if len(picked) == size:
                out.append((picked, DECAY ** (picked[-1] - size + 1)))
                return
            for place in range(picked[-1] + 1, last + 1):
                if place - len(picked) <= GAP:
                    grow((*picked, place))
        grow((0,))
    return out


PATTERNS = _patterns()
_MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/"
_SENTENCE = re.compile(r"[.!?]\s|\n")


def _joined(run: list[str], found: set[str]) -> None:
    """Neighbours of a run of short words put together, where blanks may have been put into a word."""
    for a in range(len(run) - 1):
        joined, least = run[a], len(run[a])
        for part in run[a + 1:]:
            joined, least = joined + part, min(least, len(part))
            if len(joined) > JOINED[1]:
                break
            if len(joined) >= JOINED[0] and least <= SHORTEST:
                found.add(joined)


def chunks(text: str) -> set[str]:
    """The distinct words of a text in lower case, and what neighbouring short words make together, by any white space."""
    words = text.lower().split()
    found, run = set(words), []
    for word in words:
        if len(word) <= SHORT:
            if word.isalpha():
                run.append(word)
                continue
            core = word.rstrip(_MARKS)
            if core.isalpha():
                run.append(core)
        if len(run) > 1:
            _joined(run, found)
        run = []
    if len(run) > 1:
        _joined(run, found)
    return found


def forms(chunk: str) -> list[str]:
    """What of a chunk is compared: its letters, and if they are spread out, the chunk itself; long ones in pieces."""
    core = chunk.strip(_MARKS)
    if core.isalpha():
        if len(core) <= PIECE:
            return [core] if len(core) > 1 else []
        letters = core
    else:
        letters = "".join(filter(str.isalpha, core))
    out = []
    for form in (letters,) if core == letters else (letters, core):
        if len(form) <= PIECE:
            out.append(form)
        else:
            out += [form[a: a + PIECE] for a in range(0, len(form) - PIECE // 2, PIECE // 2)]
    return [f for f in out if len(f) > 1]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, ids, weights) of the gapped subsequences of each word, a blank standing on both its sides; unit weight per row."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    length = max(map(len, words))
    codes = np.array(words, f"U{length}").view(np.uint32).reshape(len(words), length)
    sizes = np.array([len(w) for w in words]) + 2
    padded = np.full((len(words), length + 2), 32, np.uint64)
    padded[:, 1:-1] = np.where(codes, codes, 32)
    rows, ids, weights = [], [], []
    for places, weight in PATTERNS:
        room = length + 3 - 1 - places[-1]
        if room <= 0:
            continue
        total = np.zeros((len(words), room), np.uint64)
        for factor, place in zip(_FACTORS, places):
            total += padded[:, place: place + room] * factor
        row, column = np.nonzero(np.arange(room) + places[-1] < sizes[:, None])
        ids.append((mix(total[row, column], len(places)) >> np.uint64(64 - _BITS)).astype(np.int64))
        rows.append(row)
        weights.append(np.full(len(row), weight, np.float32))
    rows, ids, weights = np.concatenate(rows), np.concatenate(ids), np.concatenate(weights)
    norm = np.sqrt(np.bincount(rows, weights.astype(np.float64) ** 2, len(words)))
    return rows, ids, (weights / np.maximum(norm, 1e-9)[rows]).astype(np.float32)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel values, words by landmarks."""
    rows, ids, weights = features(words)
    at, own, own_weights = features(landmarks)
    out, table = np.zeros((len(words), len(landmarks))), np.zeros(1 << _BITS, np.float32)
    for k in range(len(landmarks)):
        mine = at == k
        np.add.at(table, own[mine], own_weights[mine])
        out[:, k] = np.bincount(rows, table[ids] * weights, len(words))
        table[own[mine]] = 0
    return out


def _svm(parts: list[np.ndarray], y: np.ndarray, cost: np.ndarray, steps: int = 15) -> np.ndarray:
    """Weights (the last is the offset) of the least squared hinge loss, by Newton steps on the examples inside the margin.

    The examples come in parts; their products are summed block by block, so nothing of their size is made twice.
    """
    blocks, at = [], 0
    for part in parts:
        for a in range(0, len(part), 1024):
            blocks.append((part[a: a + 1024], slice(at + a, at + a + len(part[a: a + 1024]))))
        at += len(part)
    size = parts[0].shape[1] + 1
    w, ridge = np.zeros(size), np.eye(size)
    ridge[-1, -1] = 1e-3
    active, now = np.ones(len(y), bool), np.empty(len(y), bool)
    for _ in range(steps):
        gram, target = ridge.copy(), np.zeros(size)
        for x, rows in blocks:
            inside = active[rows]
            own = np.hstack([x[inside], np.ones((int(inside.sum()), 1))])
            c = cost[rows][inside]
            gram += (own.T * c) @ own
            target += own.T @ (c * y[rows][inside])
        w = np.linalg.solve(gram, target)
        for x, rows in blocks:
            now[rows] = y[rows] * (x @ w[:-1] + w[-1]) < 1
        if (now == active).all():
            break
        active[:] = now
    return w


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = np.maximum(p * (1 - p), 1e-6)
        w += np.linalg.solve((x.T * d) @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
    return w


@dataclass
class Model:
    """``ids`` and ``weights`` are the folded decision; without toxic or clean labels every score is ``prior``."""

    prior: float
    ids: np.ndarray | None = None
    weights: np.ndarray | None = None
    offset: float = 0.0
    logistic: np.ndarray | None = None

    def table(self) -> np.ndarray:
        table = np.zeros(1 << _BITS, np.float32)
        table[self.ids] = self.weights
        return table


class Scorer:
    def __init__(self, model: Model, remembered: int = REMEMBERED):
        self.model, self.table, self.remembered = model, model.table() if model.ids is not None else None, remembered
        self.seen: set[str] = set()
        self.toxic: dict[str, float] = {}

    def decisions(self, words: list[str]) -> np.ndarray:
        """The machine's decision for each word form, at least ``FLOOR``."""
        out = np.full(len(words), FLOOR)
        order = np.argsort(np.fromiter(map(len, words), np.int32, len(words)), kind="stable").astype(np.int32)
        for a in range(0, len(order), WORDS_AT_ONCE):
            part = order[a: a + WORDS_AT_ONCE]
            rows, ids, weights = features([words[i] for i in part])
            out[part] = np.bincount(rows, self.table[ids] * weights, len(part)) + self.model.offset
        return np.maximum(out, FLOOR)

    def _learn(self, new: list[str]) -> None:
        owner, words = [], []
        for i, chunk in enumerate(new):
            for form in forms(chunk):
                owner.append(i)
                words.append(form)
        self.seen.update(new)
        if words:
            found = self.decisions(words)
            for k in np.flatnonzero(found > FLOOR):
                chunk = new[owner[k]]
                self.toxic[chunk] = max(float(found[k]), self.toxic.get(chunk, FLOOR))

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: the two highest decisions among its words, and the log of how many are positive."""
        if len(self.seen) > self.remembered:
            self.seen, self.toxic = set(), {}
        owned = [chunks(t) for t in texts]
        new = set().union(*owned) - self.seen if owned else set()
        self._learn(sorted(new))
        out = np.full((len(texts), 3), FLOOR)
        out[:, 2] = 0
        for i, own in enumerate(owned):
            hits = sorted([self.toxic[c] for c in own & self.toxic.keys()], reverse=True)
            out[i, : min(2, len(hits))] = hits[:2]
            out[i, 2] = np.log1p(sum(h > 0 for h in hits))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.model.prior)
        x = np.hstack([self.evidence(texts), np.ones((len(texts), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.model.logistic, -30, 30)))


def _varied(words: list[str], rng: np.random.Generator) -> list[str]:
    """Each word with one character put in at some inner place."""
    inserted = rng.integers(97, 123, len(words))
    places = rng.random(len(words))
    return [w[: (k := 1 + int(p * (len(w) - 1)))] + chr(c) + w[k:] for w, c, p in zip(words, inserted, places)]


def _distinct_texts(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each group of near copies: texts that share the smallest or largest hash of their runs of three words."""
    out, seen = [], set()
    for at in range(0, len(rows), TEXTS_AT_ONCE):
        part = rows[at: at + TEXTS_AT_ONCE]
        found = Words(*utf8(pa.array([text for text, _ in part], pa.string())))
        hashes = found.hashes(lower=True)
        runs = windows(hashes, 3)
        for row, a, b in zip(part, found.first[:-1], found.first[1:]):
            own = runs[a: b - 2] if b - a > 2 else hashes[a:b]
            marks = {int(own.min()), int(own.max())} if len(own) else set()
            if not marks & seen:
                out.append(row)
            seen |= marks
    return out


def _placed(words: list[str], landmarks: list[str], into: np.ndarray) -> np.ndarray:
    """The words in the space that the landmarks span, in single precision; a bounded part of them at a time."""
    parts = [kernel(words[a: a + 2048], landmarks) @ into for a in range(0, len(words), 2048)]
    return np.concatenate([p.astype(np.float32) for p in parts])


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label) rows, the label 1 for toxic. The order of the rows decides ties; the list is emptied."""
    labels = [label for _, label in rows]
    prior = sum(labels) / len(labels) if rows else 0.0
    if prior in (0.0, 1.0):
        return Model(prior)
    rng = np.random.default_rng(7)
    distinct = _distinct_texts(rows)
    rows.clear()
    rows = distinct
    words_of, fitting = rows[0::3] + rows[1::3], rows[2::3] if len(rows) > 300 else rows
    # The sentences themselves are not kept, only the 64 bits of their hashes; each is counted where it comes first.
    labelled: dict[int, int] = {}
    for text, label in words_of:
        for sentence in _SENTENCE.split(text.lower()):
            labelled[hash(sentence)] = min(label, labelled.get(hash(sentence), label))
    held, together = ({}, {}), {}
    for text, _ in words_of:
        for sentence in _SENTENCE.split(text.lower()):
            label = labelled.pop(hash(sentence), None)
            if label is None:
                continue
            words = set(sentence.split())
            # What neighbours happen to make together is learned as clean where it is no toxic word, and never as toxic.
            for chunk in chunks(sentence) if label == 0 else words:
                for form in forms(chunk)[:1]:
                    into = held[label] if chunk in words else together
                    into[form] = into.get(form, 0) + 1
    del rows, distinct, words_of, labelled
    share = lambda w: held[1].get(w, 0) / (held[1].get(w, 0) + held[0].get(w, 0))
    toxic = sorted((w for w, n in held[1].items() if n >= MIN_SENTENCES and share(w) >= MIN_SHARE), key=lambda w: (-held[1][w], w))[:2000]
    often = lambda counts: sorted(counts, key=lambda w: (-counts[w], w))
    clean = often(held[0])
    if not toxic or not clean:
        return Model(prior)
    together = {form: n for form, n in together.items() if form not in held[0] and form not in held[1]}
    picked = set()
    for words, n in ((clean, CLEAN_WORDS), (often(together), CLEAN_WORDS // 5)):
        common, rare = words[: n // 2], words[n // 2:]
        picked |= {*common, *(rare[i] for i in rng.permutation(len(rare))[: n // 2])}
    picked -= set(toxic)
    held[0].update(together)
    clean += together
    half = LANDMARKS // 2
    spread = lambda words, n: [words[i] for i in sorted(rng.permutation(len(words))[:n])]
    landmarks = toxic[: half // 2] + spread(toxic[half // 2:], half - half // 2)
    landmarks += spread(sorted(picked), LANDMARKS - len(landmarks))
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    good = values > 1e-6 * values[-1]
    into = vectors[:, good] / np.sqrt(values[good])
    toxic_all = toxic + [w for _ in range(VARIANTS) for w in _varied(toxic, rng)]
    toxic_x = [_placed(toxic_all, landmarks, into)]
    weight = np.array([1 + np.log(held[1][w]) for w in toxic] + [1.0] * (len(toxic_all) - len(toxic)))
    model = Model(prior)
    at, ids, landmark_weights = features(landmarks)
    pool = sorted(picked)
    clean_x = [_placed(pool, landmarks, into)]
    clean_cost = np.array([1 + np.log(held[0][w]) for w in pool])
    for _ in range(ROUNDS):
        y = np.concatenate([np.ones(len(toxic_all)), -np.ones(len(pool))])
        w = _svm(toxic_x + clean_x, y, np.concatenate([weight * 4, clean_cost]))
        folded = np.bincount(ids, landmark_weights * (into @ w[:-1])[at], 1 << _BITS)
        model.ids = np.flatnonzero(folded)
        model.weights, model.offset = folded[model.ids].astype(np.float32), float(w[-1])
        del folded
        # What is still taken for toxic counts more in the next round, the more often it occurs.
        found = Scorer(model).decisions(clean)
        decided = {clean[k]: found[k] for k in np.flatnonzero(found > FLOOR)}
        del found
        clean_cost = clean_cost * np.array([1 + 4 * (w in decided) for w in pool])
        hard = sorted((w for w in decided if w not in picked and share(w) < MIN_SHARE), key=lambda w: (-decided[w], w))
        hard = hard[: CLEAN_WORDS // 2]
        if hard:
            picked.update(hard)
            pool += hard
            clean_x.append(_placed(hard, landmarks, into))
            clean_cost = np.concatenate([clean_cost, [2 + np.log(held[0][w]) for w in hard]])
    del held, together, clean, toxic_x, clean_x, decided
    scorer = Scorer(model, REMEMBERED_FITTING)
    seen = [scorer.evidence([t for t, _ in fitting[a: a + TEXTS_AT_ONCE]]) for a in range(0, len(fitting), TEXTS_AT_ONCE)]
    model.logistic = _logistic(np.concatenate(seen), np.array([label for _, label in fitting], float))
    return model


def held_out(doc_id):
    """True for the fifth of the ids that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model from the labelled documents outside the held-out fifth.

    A bounded sample is fitted on the driver: at most ``train_docs`` documents of each class, those with the smallest hash
    of their id, as far as they have at most ``train_chars`` characters; an id that repeats counts once, with its first
    text. Null ids, labels and texts are left out; an id with several labels is toxic if one of them is.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    order = (F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"))
    drawn = [known.where(F.col("label") == k).orderBy(*order).limit(train_docs) for k in (0, 1)]
    # Two times train_docs ids at most.
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text").between(1, train_chars))
    # One text for each id: the first, if an id repeats.
    rows = texts.join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = rows.limit(2 * train_docs).toArrow()
    order = np.argsort(found.column("doc_id").to_numpy())[np.random.default_rng(1).permutation(found.num_rows)]
    rows = [(found.column("text")[i].as_py(), found.column("label")[i].as_py()) for i in order.tolist()]
    del found
    give_back()
    model = fit(rows)
    give_back()
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; all rows and columns stay, ``name`` is not among them.

    Null and empty texts are scored like any text without toxic words. No label, language or id is looked at. No shuffle.
    """
    def score(batches):
        scorer = Scorer(model)
        for batch in by_bytes(batches, text_col):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.scores(texts), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
