"""Quality measures against plain Python."""

import random
import re
from collections import Counter

from skyseries.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    total = sum(map(len, words))
    covered, repeated = [], 0
    for n in Q.TOP_LIMITS:
        count = Counter(tuple(words[i: i + n]) for i in range(len(words) - n + 1))
        covered.append(max((c * sum(map(len, run)) for run, c in count.items() if c >= 3), default=0))
    for n in Q.RUN_LIMITS:
        runs = [tuple(words[i: i + n]) for i in range(len(words) - n + 1)]
        count = Counter(runs)
        inside = {p for i, r in enumerate(runs) if count[r] > 1 for p in range(i, i + n)}
        covered.append(sum(len(words[p]) for p in inside))
        repeated = len(inside) if n == 5 else repeated
    lines = [line for line in text.split("\n") if WORD.search(line)]
    doubled = [line for i, line in enumerate(lines) if line in lines[:i]]
    covered.append(sum(len("".join(WORD.findall(line))) for line in doubled))
    limits = [*Q.TOP_LIMITS.values(), *Q.RUN_LIMITS.values(), Q.LINE_LIMIT]
    failed = len(words) < 10 or 100 * repeated > 20 * len(words)
    kept = not failed and all(c <= limit * total for c, limit in zip(covered, limits))
    return (len(words), total, len(re.findall(r"[#*$%&|<>]", text)), len(doubled), repeated, *covered, failed, kept)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "a", "é" * 3, "one\none\n\n\n one\none", "x " * 500, "\n".join(["same line of five words"] * 4), "a\x0bb\x0cc\rd", "#*$%&|<> ##"]
    for _ in range(60):
        words = [rng.choice(["the", "of", "Größe", "ñ", "x#", "lo"]) + str(rng.randrange(rng.choice([2, 5, 500]))) for _ in range(rng.randrange(1, 150))]
        cut = rng.randrange(len(words))
        if rng.random() < 0.5:
            words += words[cut: cut + 30]
        out.append("".join(w + rng.choice([" ", "  ", "\n", " "]) for w in words))
    return out


def test_measures(spark):
    rows = list(enumerate(texts()))
    found = Q.measures(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == {i: plain(t) for i, t in rows}


def test_kept_rows_stay_as_they_are(spark):
    good = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, good, 5), (1, good, 5), (None, good, None), (3, "x " * 50, 1), (4, None, 2)], "doc_id bigint, text string, _quality int")
    assert sorted((tuple(r) for r in Q.kept(df).collect()), key=repr) == [(1, good, 5), (1, good, 5), (None, good, None)]
    assert Q.kept(df).columns == df.columns
    assert Q.kept(df.limit(0)).collect() == []


def test_a_short_phrase_between_other_words_is_found():
    rng = random.Random(3)
    fill = [f"word{rng.randrange(10**6)}" for _ in range(60)]
    phrase = " ".join(w + (" buy this now" if i % 3 == 0 else "") for i, w in enumerate(fill))
    n = Q.MEASURES.names
    row = Q.measure(__import__("pyarrow").array([phrase]))[0]
    assert not row[n.index("base_failed")] and not row[n.index("kept")] and row[n.index("top3_chars")] == 20 * 10
    assert Q.measure(__import__("pyarrow").array([" ".join(fill) + " buy this now buy this now"]))[0][n.index("kept")]
