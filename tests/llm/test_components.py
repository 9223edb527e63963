"""Components against a walk over the graph."""

import random

from skyseries.llm.components import connected


def walked(edges):
    near, out = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for node in sorted(near):
        todo = [] if node in out else [node]
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = node
                todo += near[at]
    return out


def test_chains_stars_and_random_graphs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(-3, 900), (900, 901), (7, 8), (8, 7), (8, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    edges = [e for e in edges if e[0] != e[1]]
    found = connected(spark.createDataFrame(edges + [(3, 3)], "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == walked(edges)


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
