import numpy as np

from quillgrid.llm import embedding_dedup


def brute(rows, cosine):
    ok = [i for i, (_, v, lab) in enumerate(rows) if v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = dict.fromkeys(parent, 0)
    for i in ok:
        for j in ok:
            if i < j and rows[i][2] == rows[j][2]:
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[rows[i][0]] += 1
                    links[rows[j][0]] += 1
                    a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                    parent[b] = a
    return {d: (links[d], find(d)) for d in parent}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        rows.append([i, rng.normal(size=24).tolist(), int(rng.integers(0, 3))])
    for i in range(400, 700):
        j = int(rng.integers(0, 100))
        noise = rng.normal(size=24) * rng.choice([0, 0.05, 0.2])
        rows.append([i, (np.array(rows[j][1]) + noise).tolist(), rows[j][2]])
    rows += [[800, None, 1], [801, [0.0] * 24, 1], [802, [float("nan")] * 24, 1], [803, rows[0][1], None], [804, [None] + [1.0] * 23, 1], [805, [], 1], [806, [float("inf")] * 24, 1]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, v int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.similar_vectors(df).collect()}
    want = brute(rows, 0.93)
    assert set(got) == set(want)
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert 0.95 * there <= found <= there and there > 500
    assert all(got[d].n_links <= n for d, (n, _) in want.items())
    assert all(got[d].component_id == d and got[d].kept and got[d].n_links == 0 for d in range(800, 807))
    assert np.mean([got[d].component_id == c for d, (_, c) in want.items()]) > 0.98


def test_repeated_null_and_empty(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], schema)).collect() == []
    got = embedding_dedup.similar_vectors(spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0, 3.0], 1), (None, [1.0, 2.0], 1)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == [("1", 1, "1", True), ("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True), ("None", 0, "None", True)]


def test_recall_at_every_width():
    """Pairs just at the threshold meet in some table, for chunks as long as 100 to a thousand million vectors make them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(100_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(2000, 64))
    y -= (y * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x[:2000] + np.sqrt(1 - 0.93**2) * y
    for width in (8, 13, 16, 17, 20, 24, 30):
        tables = embedding_dedup.tables_of(width, 64, 0.93)
        assert all(w == width for _, _, w in tables)
        quantiser = embedding_dedup.Quantiser(x[: embedding_dedup.SAMPLE], tables[-1][0] + 1)
        differ = (quantiser.codes(x[:2000]) ^ quantiser.codes(y)).view(np.uint64)
        met = np.zeros(2000, bool)
        for r, a, w in tables:
            met |= np.bitwise_count((differ[:, r] >> np.uint64(a)) & np.uint64((1 << w) - 1)) <= 1
        met &= np.bitwise_count(differ).min(axis=1) <= embedding_dedup.MOST_BITS
        assert met.mean() > 0.93, width


def test_meetings_are_the_one_bit_neighbours():
    rng = np.random.default_rng(4)
    for width in (1, 2, 5, 8):
        codes = np.sort(rng.integers(0, 1 << width, 200).astype(np.uint64))
        found = set()
        for side, half in ((0, codes >> np.uint64(width // 2)), (1, codes & np.uint64((1 << width // 2) - 1))):
            for h in np.unique(half):
                at = np.flatnonzero(half == h)
                for i, j in embedding_dedup.meetings(codes[at], embedding_dedup.flips_of(width, side)):
                    pairs = [tuple(sorted(p)) for p in zip(at[i].tolist(), at[j].tolist(), strict=True)]
                    assert not found & set(pairs) and len(set(pairs)) == len(pairs)
                    found |= set(pairs)
        assert found == {(i, j) for i in range(200) for j in range(i + 1, 200) if int(codes[i] ^ codes[j]).bit_count() <= 1}


def test_sample_is_not_sent_by_every_task(spark):
    """What comes to the driver doesn't grow with the number of tasks."""
    store = spark.sparkContext._jsc.sc().statusStore()
    rng = np.random.default_rng(5)
    rows = [(i, x, 1) for i, x in enumerate(rng.normal(size=(16_000, 32)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    sc = spark.sparkContext
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    sc.setJobGroup("sample", "sample")
    try:
        assert embedding_dedup.similar_vectors(df).where("n_links > 0").count() == 0
        stages = {k for j in sc.statusTracker().getJobIdsForGroup("sample") for k in sc.statusTracker().getJobInfo(j).stageIds}
        stages = [store.lastStageAttempt(k) for k in stages]
        assert 500_000 < max(x.resultSize() for x in stages if x.name().startswith("collect")) < 2_500_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        sc.setLocalProperty("spark.jobGroup.id", None)
