import random
from collections import Counter
from fractions import Fraction
from math import ceil

import pytest
from pyspark.sql import functions as F

from quillgrid.llm import mixing


def edf(a):
    period, done, out = sum(a), [0] * len(a), []
    for t in range(period):
        ready = [(ceil(Fraction((k + 1) * period, w)), i) for i, (k, w) in enumerate(zip(done, a, strict=True)) if k * period // w <= t]
        i = min(ready)[1]
        done[i] += 1
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_schedule(spark, seed):
    rng = random.Random(seed)
    a = [rng.randint(1, 12) for _ in range(rng.randint(1, 7))]
    got = spark.range(1).select(mixing.schedule(F.array(*[F.lit(x).cast("long") for x in a]))).first()[0]
    assert got == edf(a)
    done = Counter()
    for t, i in enumerate(got, 1):
        done[i] += 1
        assert all(abs(done[j] - Fraction(t * w, sum(a))) < 1 for j, w in enumerate(a))


def test_mix(spark):
    rows = [(i, ["a", "b", "c", None][min(3, i % 11)], f"t{i}") for i in range(500)] + [(7, "b", "same"), (7, "b", "same"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, a string").repartition(3)
    got = mixing.mix(df, weights={"a": 3, "b": 2, None: 4}, block=4).collect()
    assert Counter((r.doc_id, r.source, r.a) for r in got if r.epoch == 0) == Counter(rows)
    assert len({r.position for r in got}) == len(got)
    order = sorted({(r.slot, r.source, r.block, r.epoch) for r in got}, key=lambda x: x[0])
    assert [x[0] for x in order] == list(range(len(order)))
    weight = {"a": 3, "b": 2, "c": 1, None: 4}
    done = Counter()
    for t, (_, s, _, _) in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[k] - Fraction(t * w, 10)) < 1 for k, w in weight.items())
    assert min(Counter(r.source for r in got if r.epoch == 0).values()) > 0


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).collect() == []


def test_many_sources(spark):
    n = 3000
    df = spark.range(4 * n).selectExpr("id AS doc_id", f"CAST(id % {n} AS STRING) AS source", "'x' AS slot", "1 AS __row")
    got = mixing.mix(df, block=1).collect()
    assert len({r.position for r in got}) == len(got) >= 4 * n and {r.doc_id for r in got} == set(range(4 * n))
    assert got[0].asDict().keys() == {"doc_id", "source", "__row", "epoch", "block", "slot", "position"}
