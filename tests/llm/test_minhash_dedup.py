import random
import re

from quillgrid.llm import minhash_dedup


def brute(rows, width, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, _) in enumerate(rows):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(d), find(rows[j][0])))
                parent[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(rows, sets, strict=True))


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("aBcdeÉf") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=25)
    rows, n = [], 0

    def add(w):
        nonlocal n
        rows.append((n * 7 % 1009, " ".join(w)))
        n += 1

    for _ in range(60):
        add(rng.choices(vocabulary, k=rng.randint(1, 80)) + passage)
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randint(20, 120))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add(copy)
    base = rng.choices(vocabulary, k=100)
    for i in range(40):  # a chain: neighbours are similar, the ends are not
        base[2 * i : 2 * i + 1] = [f"new{i}"]
        add(base)
    for t in (["one"], ["one"], ["one", "two"], ["ONE", "two"], [], ["  \t"], []):
        add(t)
    rows.append((2000, None))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, token string").repartition(3)
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(df, width=3, similarity=0.85).collect())
    assert got == brute(rows, 3, 85)


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(empty).collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False)]))


def test_family_without_a_hub(spark):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for d in range(150):  # heavy edits, and copies of copies
        copy = list(rng.choice(rows)[1].split()) if rows and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(df, width=3, similarity=0.85).collect())
    assert got == brute(rows, 3, 85)


def test_a_family_just_below_the_similarity(spark, monkeypatch):
    """Copies of one base that are mostly too far apart, in several blocks of a list."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 40 * minhash_dedup.ROW_BYTES)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(150):
        copy = list(base)
        for k in rng.sample(range(60), 2):
            copy[k] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in minhash_dedup.near_duplicates(df, width=3, similarity=0.85).collect())
    assert got == brute(rows, 3, 85)
    assert 20 < sum(r[3] for r in got) < 150


def test_an_id_with_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g"), (3, "p q r s t u v"), (4, "h i j k l m n")]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_matches_needed():
    assert minhash_dedup.matches_needed(0.85) == 29 or 26 <= minhash_dedup.matches_needed(0.85) <= 31
