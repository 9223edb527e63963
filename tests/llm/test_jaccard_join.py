"""Near duplicates against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from skyseries.llm import jaccard_join as J


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def all_pairs(rows):
    """(id, set size, smallest reachable id) per row, as the sorted list of results."""
    own = [(doc, shingles(text)) for doc, text in rows]
    above = {doc: doc for doc, _ in own if doc is not None}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, (a, x) in enumerate(own):
        for b, y in own[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                first, second = sorted((root(a), root(b)))
                above[second] = first
    return sorted(((doc, len(s), None if doc is None else root(doc)) for doc, s in own), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    rows, number = [], iter(range(0, 100_000, 3))
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 120]))]
        if rng.random() < 0.4:
            base += passage.split()
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((next(number), " ".join(copy)))
    # A large group whose members differ by more and more.
    base = [word() for _ in range(150)]
    for step in range(40):
        base[rng.randrange(len(base))] = word()
        rows.append((next(number), " ".join(base)))
    rows += [(next(number), passage)] * 2 + [(next(number), t) for t in (None, "", " \n\t", "One two", "one  TWO", "one two three four five", "ÄB c", "äb c", passage)]
    rows += [(None, passage), (None, None)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    return sorted((tuple(r) for r in J.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize("long_list, block, buckets", [(256, 2048, 250_000), (3, 5, 100)])
def test_same_links_as_all_pairs(spark, monkeypatch, long_list, block, buckets):
    """Also where lists are long, blocks take several tasks and the second round is needed."""
    monkeypatch.setattr(J, "LONG_LIST", long_list)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "BUCKET", buckets)
    rows = corpus()
    assert run(spark, rows) == all_pairs(rows)


def test_no_rows_and_nothing_but_blank_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, ""), (2, None)]) == [(1, 0, 1), (2, 0, 2)]


def test_rows_of_one_id_are_one_node(spark):
    one, other = "a b c d e f g", "q r s t u v w"
    assert run(spark, [(5, one), (9, one), (9, other), (12, other)]) == [(12, 3, 5), (5, 3, 5), (9, 3, 5), (9, 3, 5)]


def test_extra_columns_with_the_names_used_inside(spark):
    df = spark.createDataFrame([(1, "a b", 2, 3), (2, "A  b", 4, 5)], "doc_id bigint, text string, node int, component int")
    assert sorted(tuple(r) for r in J.near_duplicates(df).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_t_occurrence_joins_what_links_join():
    rng = np.random.default_rng(1)
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate((base[rng.random(60) < 0.95], rng.integers(0, 1 << 60, rng.integers(0, 9), dtype=np.uint64)))) for _ in range(12)]
        sets += [np.unique(rng.integers(0, 40, 30, dtype=np.uint64)) for _ in range(5)]
        links = {(i, j) for i in range(17) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
        assert parts(17, J.t_occurrence(sets)) == parts(17, links)


def parts(n, links):
    forest = J._Forest(n)
    for i, j in links:
        forest.join(i, j)
    return Counter(tuple(np.flatnonzero(forest.roots() == r)) for r in set(forest.roots().tolist()))
