"""Toxicity: the kernel against its definition, and accuracy on documents that no model has learned from."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from skyseries.llm import toxicity as T

INSULTS = ["blorgface", "zwuntling", "krappok", "vuzzhead", "drimscum", "glontard"]


def test_kernel_is_the_inner_product_of_gapped_subsequences():
    def vector(word):
        padded, out = f" {word} ", Counter()
        for size in (3, 4):
            for places in itertools.combinations(range(len(padded)), size):
                skipped = places[-1] - places[0] + 1 - size
                if skipped <= T.GAP:
                    out["".join(padded[p] for p in places)] += T.DECAY ** skipped
        norm = sum(T.DECAY ** (2 * (p[-1] - p[0] + 1 - size)) for size in (3, 4) for p in itertools.combinations(range(len(padded)), size) if p[-1] - p[0] + 1 - size <= T.GAP)
        return {k: v / norm ** 0.5 for k, v in out.items()}

    words = ["idiot", "idxiot", "thing", "aa", "naïve", "ab"]
    vectors = [vector(w) for w in words]
    expected = [[sum(v * b.get(k, 0) for k, v in a.items()) for b in vectors] for a in vectors]
    # Two different subsequences may share a hash.
    assert np.abs(T.kernel(words, words) - np.array(expected)).max() < 0.02
    near = T.kernel(["idiot"], ["idxiot", "idiiot", "idot", "thing"])[0]
    assert near[:3].min() > 3 * max(near[3], 0.01)


def test_chunks_and_forms():
    assert T.chunks("An i d i o t there, A b") >= {"idiot", "an", "there,", "b"}
    assert T.chunks("so tr ash. t  ra\n\tsh!") >= {"trash", "so", "tr", "ash."}
    assert T.chunks("longer words. stay apart") == {"longer", "words.", "stay", "apart"}
    assert T.forms("id.iot,") == ["idiot", "id.iot"] and T.forms("plain") == ["plain"] and T.forms("...") == []
    long = "".join(chr(97 + i % 26) for i in range(1000))
    assert all(any(long[a: a + 8] in f for f in T.forms(long)) for a in range(0, 990))


def rows(n=900, seed=5):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "ti"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(10, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        out.append((i, " ".join(w + rng.choice(["", "", ".", ","]) for w in words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def model():
    return T.fit([(text, label) for _, text, label in rows()])


def test_unseen_documents(model):
    unseen = rows(400, seed=6)
    predicted = T.Scorer(model).scores([t for _, t, _ in unseen]) >= 0.5
    assert np.mean(predicted == np.array([label for _, _, label in unseen], bool)) > 0.97


def test_inserted_and_spread_characters(model):
    plain = " ".join(["therein andhe onti rehe"] * 10)
    texts = [f"{plain} {w} {plain}" for insult in INSULTS for w in (insult, insult.upper() + "!", insult[:4] + "x" + insult[4:], " ".join(insult), "  ".join(insult), ".".join(insult))]
    assert np.mean(T.Scorer(model).scores(texts) >= 0.5) > 0.85
    halves = [f"{plain} {w[:3]} {w[3:6]} {w[6:]} {plain}" for w in ("blorgface", "vuzzhead", "drimscum", "glontard")]
    assert np.mean(T.Scorer(model).scores(halves) >= 0.5) >= 0.75
    assert T.Scorer(model).scores([plain, "", "the in on the re he ed"]).max() < 0.5


def test_fitting_holds_few_texts_and_words_at_a_time(model, monkeypatch):
    texts, words = [], []
    evidence, features = T.Scorer.evidence, T.features
    monkeypatch.setattr(T.Scorer, "evidence", lambda self, own: texts.append(len(own)) or evidence(self, own))
    monkeypatch.setattr(T, "features", lambda own: words.append(len(own)) or features(own))
    again = T.fit([(text, label) for _, text, label in rows()])
    assert sum(texts) > 200 and max(texts) <= 32
    # The driver decides on every clean word in each round.
    assert sum(words) > 20_000 and max(words) <= 2048
    # What is held together changes no result.
    monkeypatch.setattr(T, "TEXTS_AT_ONCE", 1000)
    monkeypatch.setattr(T, "WORDS_AT_ONCE", 1 << 20)
    monkeypatch.setattr(T, "REMEMBERED_FITTING", 100)
    whole = T.fit([(text, label) for _, text, label in rows()])
    for one in (again, whole):
        assert (one.ids == model.ids).all() and (one.weights == model.weights).all() and np.allclose(one.logistic, model.logistic, atol=1e-9)


def test_training_data_is_summed_in_blocks():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2500, 7)).astype(np.float32)
    y, cost = np.sign(x @ rng.normal(size=7) + 0.3 * rng.normal(size=2500)), rng.uniform(1, 3, 2500)
    whole = T._svm([x], y, cost)
    assert np.allclose(whole, T._svm([x[:900], x[900:901], x[901:]], y, cost), atol=1e-6)
    margin = np.maximum(1 - y * (x @ whole[:-1] + whole[-1]), 0)
    # The gradient of the loss is zero there.
    assert np.abs(whole[:-1] - x.T @ (cost * y * margin)).max() < 1e-3


def test_ids_that_repeat_count_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, f"own {i} words") for i in range(2, 40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    seen = []
    fit, T.fit = T.fit, lambda rows: seen.extend(rows)
    try:
        T.train(docs, labels)
    finally:
        T.fit = fit
    texts = [t for t, _ in seen]
    assert len(texts) == len(set(texts)) and sum(t.startswith("text") for t in texts) <= 1

def test_training_reads_no_held_out_label_and_bounds_its_sample(spark):
    data = rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, "x"), (9999, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in data] + [(None, 1), (9999, 1), (3, None)], "doc_id bigint, toxic int")
    hidden = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    flags = docs.select("doc_id", T.held_out(docs.doc_id).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and hidden(r.doc_id)) for r in flags)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    one, two = T.train(docs, labels), T.train(docs, turned)
    assert (one.ids == two.ids).all() and (one.logistic == two.logistic).all()
    scored = T.scored(docs, one).collect()
    right = [(r.score >= 0.5) == bool(data[r.doc_id][2]) for r in scored if r.doc_id is not None and r.doc_id < 600 and hidden(r.doc_id)]
    assert len(scored) == 602 and np.mean(right) > 0.95


def test_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    for labels in (none, one):
        assert {r.score for r in T.scored(docs, T.train(docs, labels)).collect()} == {0.0}
    assert T.scored(docs.limit(0), T.train(docs, none)).collect() == []
