import random

import pytest

from quillgrid.llm import graph, store


def brute(links):
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = random.Random(3)
    ids = rng.sample(range(-500, 500), 300)
    links = {"random": [(rng.choice(ids), rng.choice(ids)) for _ in range(180)], "chain": list(zip(ids, ids[1:60])), "star": [(ids[0], x) for x in ids[1:]]}[kind]
    links = [(a, b) for a, b in links if a != b]
    work = store.Work(spark, "test")
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    assert {r.id: r.component for r in graph.components(df(links), work).collect()} == brute(links)
    cut = len(links) // 2
    known = work.save(graph.components(df(links[:cut]), work))
    assert {r.id: r.component for r in graph.components(df(links[cut:]), work, known).collect()} == brute(links)
    assert graph.components(df([]), work).collect() == []
