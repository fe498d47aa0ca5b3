import random

import numpy as np
import pytest

from quillgrid.llm import decontaminate


def naive(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@pytest.mark.parametrize("seed", range(20))
def test_alignment_against_full_matrix(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randint(1, 30))] for _ in "ab")
    assert decontaminate.align(np.array(a), np.array(b))[0] == naive(a, b)


def test_finds_planted_and_only_them(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(3000)] + ["the", "of", "and"] * 400
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.randint(12, 50))) for i in range(30)]
    docs, want = [], set()
    for d in range(400):
        w = text(rng.randint(0, 300))
        if d % 4 == 0:
            i, passage = rng.choice(items)
            p = list(passage)
            for _ in range(len(p) // 4):
                at = rng.randrange(len(p))
                p[at : at + 1] = rng.choice(([], ["new"], [p[at], "more"]))
            w[(at := rng.randint(0, len(w))) : at] = [x.title() + rng.choice(("", ",", ".")) for x in p]
            want.add((d, i))
        docs.append((d, " ".join(w), 5))
    docs += [(1000, None, 5), (1001, "", 5), (1002, " ".join(items[3][1]), 5), (1002, " ".join(items[3][1]), 5)]
    want.add((1002, 3))
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(90, None), (91, "a b"), (92, "")], "item_id long, text string")
    got = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    whole = [r for r in got if r.doc_id == 1002]
    assert len(whole) == 2 and all(r.score == 1 and (r.begin_word, r.end_word) == (0, len(items[3][1])) for r in whole)


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    bench = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i}") for i in range(7)], "item_id long, text string")
    df = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i}") for i in range(7)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()) == [(i, i) for i in range(7)]
    assert decontaminate.find_leaks(df, bench.limit(0)).collect() == []
    assert decontaminate.find_leaks(df.limit(0), bench).collect() == []


def test_short_items_and_several_copies(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "Zebra"), (3, "green moon")], "item_id long, text string")
    rows = [(1, "one two three four five six one two three four five six and more"), (2, "a zebra, here"), (3, "a green moon"), (4, "green and moon and no such thing"), (5, "zebras"), (None, "zebra"), (6, "w " * 30000 + "one two three four five six")]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.begin_word, r.end_word) for r in got if r.score == 1) == [("1", 1, 0, 6), ("1", 1, 6, 12), ("2", 2, 1, 2), ("3", 3, 1, 3), ("6", 1, 30000, 30006), ("None", 2, 0, 1)]
