import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from quillgrid.llm import maxent_lm


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["</end>"]


def test_counts_and_base_score(spark):
    rng = random.Random(2)
    en, de = ["The", "of", "and", "house", "dog"], ["der", "und", "Haus", "hünd", "Zug"]
    rows = []
    for d in range(240):
        w = rng.choice((en, de))
        rows.append((d, " ".join(rng.choice(w) if rng.random() < 0.9 else f"x{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))))
    rows += [(900, None), (901, ""), (902, " \n"), (3, "the the")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, dst int").repartition(3)
    got = sorted(maxent_lm.score(df).collect(), key=lambda r: (r.doc_id, r.n_tokens, r.base_score))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((d, held(d), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t))) for d, t in rows)
    assert [r[:5] for r in want] == [tuple(r)[:5] for r in got]
    assert np.allclose([r[5] for r in want], [r.base_score for r in got])
    out = [r for r in got if r.held_out]
    assert all(r.score <= 0 for r in got)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(3 * maxent_lm.TABLE + 1, maxent_lm.CLASSES)).astype(np.float32)
    rows = [np.arange(5) + i * maxent_lm.TABLE for i in range(3)]
    assert np.allclose(np.exp(maxent_lm.log_softmax(w, rows)).sum(axis=1), 1, atol=1e-5)
    count = np.array([1, 1, 2, 5, 5, 900])
    kind = maxent_lm.class_of(count)
    mass = np.bincount(kind, count, maxent_lm.CLASSES)
    assert np.allclose(np.bincount(kind, count / mass[kind])[np.unique(kind)], 1)


def test_empty(spark):
    assert maxent_lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_weights_learn_from_all_training_text(spark):
    # a source that comes after 330 000 tokens of another one; in it, a word seen once follows each "z"
    rng = random.Random(5)
    first = [(d, "a b c " * 1000) for d in range(110)]
    last = [(d, " ".join(f"z u{rng.randrange(10**9)}" for _ in range(40))) for d in range(1000, 1200)]
    df = spark.createDataFrame(first + last, "doc_id long, text string").coalesce(1)
    got = [r for r in maxent_lm.score(df).collect() if r.doc_id >= 1000 and r.held_out]
    # weights of the first 300 000 tokens only give -2.1 digits a token, the base estimate -3.6
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -0.5


def test_table_grows_with_distinct_features():
    sizes = [maxent_lm.table_rows(n) for n in (0, 1, 10**6, 10**8, 10**10)]
    assert sizes[0] == sizes[1] == maxent_lm.TABLE and sizes[2] < sizes[3] < sizes[4]
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 50_000, np.uint64)
    assert abs(maxent_lm.distinct_of(maxent_lm.least(np.concatenate([hashes, hashes]))) / 50_000 - 1) < 0.25


def some_text():
    rng = random.Random(9)
    follow = {"the": ["cat", "dog", "bird"], "a": ["house", "tree"], "cat": ["sleeps", "eats"], "dog": ["barks", "eats"], "bird": ["sings"], "house": ["stands"], "tree": ["stands", "grows"]}
    rows = []
    for d in range(400):
        words = []
        while len(words) < 60:
            w = rng.choice(["the", "a"])
            while w:
                words.append(w)
                w = rng.choice(follow[w]) if w in follow else None
        rows.append((d, " ".join(words)))
    return rows


def test_scores_depend_on_the_rows_alone(spark):
    rows = some_text() + [(5, "the cat"), (None, "the dog"), (None, None)]
    score = lambda df: sorted((str(r.doc_id), r.n_tokens, r.score) for r in maxent_lm.score(df).collect())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    random.Random(1).shuffle(rows)
    assert score(df.repartition(2)) == score(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))


def test_words_are_learned_within_classes(spark):
    # words of one class follow different words: shares of a class alone can't tell them apart
    got = [r for r in maxent_lm.score(spark.createDataFrame(some_text(), "doc_id long, text string")).collect() if r.held_out]
    text = dict(some_text())
    count = Counter(w for d, t in some_text() if zlib.crc32(str(d).encode()) % 7 != 2 for w in tokens(t))
    of = {w: int(maxent_lm.class_of(np.array([n]))[0]) for w, n in count.items()}
    mass = Counter()
    for w, n in count.items():
        mass[of[w]] += n
    # a model that knew each token's class for certain, but only shares of words within it
    share = sum(math.log10(count[w] / mass[of[w]]) for r in got for w in tokens(text[r.doc_id]))
    assert sum(r.score for r in got) > share
    assert sum(r.score for r in got) > 0.75 * sum(r.base_score for r in got)


def test_subclasses_share_all_of_a_class():
    mass = np.array([[0.0, 5, 0, 3], [0, 0, 0, 0]])
    share = np.where(mass > 0, maxent_lm.log_share(mass, 0), np.float32(-1e4))
    assert np.allclose(np.exp(share[0]), [0, 5 / 8, 0, 3 / 8])


def test_null_ids_and_long_texts(spark):
    rows = [(None, "a b"), (None, None), (1, "word " * 400_000), (2, "x" * 3_000_000), (3, "a b")]
    got = maxent_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 400_001), ("2", 2), ("3", 3), ("None", 1), ("None", 3)]
    held = {str(r.doc_id): r.held_out for r in got}
    assert held["None"] == (zlib.crc32(b"") % 7 == 2) and all(np.isfinite([r.score, r.base_score]).all() for r in got)


def test_tokens_are_hashed_and_sorted_once(monkeypatch):
    texts = [b"a b a", b"", b"B c", b"d " * 50, b"a d e"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    monkeypatch.setattr(maxent_lm, "SLICE", 8)
    met, stream = [], maxent_lm.stream
    monkeypatch.setattr(maxent_lm, "stream", lambda *x: met.append(len(x[0])) or stream(*x))
    u, parts = maxent_lm.numbered_words(raw, offsets)
    assert sum(met) == len(raw) and len(parts) > 2
    whole, at = stream(raw, offsets)
    assert u.tolist() == sorted(set(whole.tolist()))
    assert np.concatenate([t for _, _, t, _, _ in parts]).tolist() == whole.tolist() == u[np.concatenate([word for *_, word in parts])].tolist()
    assert [at[a + 1 : b + 1].tolist() for a, b, *_ in parts] == [(at[a] + mine[1:]).tolist() for a, _, _, mine, _ in parts]
