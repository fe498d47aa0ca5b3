import random

import numpy as np

from quillgrid.llm import language_id


def naive(sample, text):
    n, at = 1, 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in sample:
            size += 1
        # the phrase ends before the byte that doesn't fit; that byte begins the next one
        if at + size > len(text):
            break
        n += 1
        at += size - 1 if size > 1 else 0
        if text[at : at + 1] not in sample:
            at += 1
    return n


def test_phrases_against_naive():
    rng = random.Random(3)
    sample = bytes(rng.choice(b"abcd ") for _ in range(300))
    texts = [bytes(rng.choice(b"abcde ") for _ in range(rng.randint(0, 200))) for _ in range(50)]
    p = language_id.CrossParser({"x": sample})
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = p.phrases(raw, offsets)[:, 0]
    assert [int(g) for g, t in zip(got, texts, strict=True) if t] == [naive(sample, t) for t in texts if t]


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    syllables = {"aa": ["the", "ing", "ou", "wh"], "bb": ["der", "ung", "ü", "sch"], "cc": ["ção", "que", "os", "é"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 300))), k, 9) for i in range(300) for k in [rng.choice(list(syllables))]]
    odd = [(900, None, "aa", 9), (901, "", "aa", 9), (902, "12 34 !!", "bb", 9), (903, "the ing the", None, 9), (904, "漢字", None, 9), (None, "der ung", "bb", 9)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score int").repartition(3)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == 306
    held = [r for r in rows if got[r[0]].held_out]
    assert 30 < len(held) < 100
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.98
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert got[903].lang_pred == "aa" and got[904].lang_pred in syllables and got[None].lang_pred == "bb" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language_id.identify(df).collect()] == ["und"]
    assert language_id.identify(df.limit(0)).collect() == []


def test_a_carried_text_is_sent_once(spark):
    df = spark.createDataFrame([(i, f"some words {i} of a text", "en", i * 2) for i in range(20)] + [(20, None, "en", 40)], "doc_id long, text string, lang string, v int")
    found = language_id.identify(df, carry=["v", "text"])
    assert {(r.doc_id, r.text, r.v) for r in found.collect()} == {(r.doc_id, r.text, r.v) for r in df.collect()}
    plan = found._jdf.queryExecution().analyzed().toString()
    sent = next(line for line in plan.split("\n") if "MapInArrow" in line)
    assert "carry" in sent and "text" in sent


def test_workers_give_memory_back(monkeypatch):
    from quillgrid.llm import store

    met = []
    monkeypatch.setattr(store, "lean", lambda: met.append("lean"))
    for x in store.leanly(lambda batches: (x + 1 for x in batches))([1, 2]):
        met.append(x)
    assert met == ["lean", 2, 3, "lean"]
