import hashlib
import random

import numpy as np
import pytest

from quillgrid.llm import suffix_dedup


def brute(rows):
    first = {}
    low = -(1 << 63)
    key = lambda d: low if d is None else d
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=3, target=4000, **limits):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, dst string").repartition(parts)
    with pytest.MonkeyPatch.context() as patch:
        for name, value in ({"CHUNK": target, "PER_BUCKET": 1, "BATCH": 64} | limits).items():
            patch.setattr(suffix_dedup, name, value)
        got = suffix_dedup.remove_repeats(df).collect()
    return sorted([(r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), r.kept_sha256) for r in got], key=str)


def some_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 12, 30, 60)]
    rows = []
    for d in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts.insert(rng.randint(0, len(parts)), p[rng.randint(0, 10) : len(p) - rng.randint(0, 10)])
        rows.append((rng.randint(0, 400), "".join(parts)))
    rows += [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 5000), (7, "a" * 70), (None, "b" * 60), (505, "b" * 90), (506, "x" * 60), (506, "x" * 60)]
    rows += [(600 + i, passages[3] + word()) for i in range(40)] + [(700 + i, rows[0][1]) for i in range(5)]
    return rows


def test_against_brute_force(spark):
    rows = some_rows()
    assert run(spark, rows) == brute(rows)


def test_hot_anchors_and_long_texts(spark):
    rng = random.Random(6)
    line = "a line that very many documents hold between their own words."
    rows = [(d, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 12))) + line + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 12)))) for d in range(250)]
    rows += [(300, "".join(rng.choice("pq") for _ in range(9000))), (301, rows[3][1] * 50)]
    assert run(spark, rows, HOT=2) == run(spark, rows, target=1 << 20) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_levels_stay_few():
    family = suffix_dedup.SuffixLevels()
    text = suffix_dedup.suffixes(bytes(range(250)))
    for i in range(100):
        keys, docs, _ = suffix_dedup.distinct(text[[i * 2, i]], np.array([i, i]))
        family.add(keys, docs)
    assert len(family.levels) <= 8
    docs = family.scan(text[[6, 2, 199]])
    assert list(docs[:2]) == [3, 1] and docs[2] > 10**12


def test_anchors_spread_over_buckets():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 123, 1 << 20, dtype=np.uint8)
    entry, s0, s1, _ = suffix_dedup.runs_of(raw, np.array([0, len(raw)]))
    count = np.bincount((entry >> np.uint64(58)).astype(np.int64), minlength=64)
    assert count.max() < 1.2 * count.mean() and (s1 - s0).sum() + len(s0) == len(raw) - 49
