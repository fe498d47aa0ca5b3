"""The registered queries over whole small tables, against brute force."""

import base64
import hashlib
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from quillgrid.llm import decontaminate, language_id, queries
from quillgrid.llm.kernels import words
from tests.llm import test_embedding_dedup, test_language_id, test_minhash_dedup, test_sharding, test_suffix_dedup

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the test tables are not here")


def rows(name):
    return pq.read_table(f"{D}/{name}.parquet").to_pylist()


def run(spark, name):
    return queries.QUERIES[name](spark, D).collect()


def test_op1(spark):
    got = sorted(map(tuple, run(spark, "op1_suffix_dedup")), key=str)
    assert got == test_suffix_dedup.brute([(r["doc_id"], r["text"]) for r in rows("documents")])
    assert sum(r[2] for r in got) > 0


def test_op3(spark):
    pages = rows("pages")
    keeper = {}
    for r in pages:
        keeper[r["html"] or ""] = max(keeper.get(r["html"] or "", -1), r["page_id"])
    want = []
    for r in pages:
        h = r["html"] or ""
        k = keeper[h]
        want.append((r["page_id"], len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if k == r["page_id"] else "revisit", None if k == r["page_id"] else k))
    assert sorted(map(tuple, run(spark, "op3_warc"))) == sorted(want)


def test_op4(spark):
    got = run(spark, "op4_sharding")
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows("documents")}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(d, len(t) + 1, zlib.crc32(t)) for d, t in docs.items()}
    count = Counter(r.shard for r in got)
    assert set(count) <= set(range(16)) and max(count.values()) - min(count.values()) <= 1 and {r.law for r in got} == {"rows"}
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in sorted(count) for i in range(count[s])]
    sizes = [[r["size"] for r in got if r.old_shard == i] for i in range(12)]
    assert sum(r["size"] for r in got if r.shard != r.old_shard) == test_sharding.cheapest(sizes, 16)


def test_op5(spark):
    got = sorted(map(tuple, run(spark, "op5_minhash_dedup")))
    assert got == test_minhash_dedup.brute([(r["doc_id"], r["text"]) for r in rows("documents")], 3, 85)


def test_op6(spark):
    vectors = [(r["vec_id"], r["embedding"], r["label"]) for r in rows("embeddings")]
    want = test_embedding_dedup.brute(vectors, 0.93)
    got = {r.vec_id: r for r in run(spark, "op6_embedding_dedup")}
    there = sum(n for n, _ in want.values())
    assert set(got) == set(want) and 0.9 * there <= sum(r.n_links for r in got.values()) <= there


def test_op7(spark):
    lang = {r["doc_id"]: r["lang"] for r in rows("documents")}
    got = run(spark, "op7_language_id")
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.9
    # every prediction, by parsing each text against each language's sample byte by byte
    docs = spark.read.parquet(f"{D}/documents.parquet")
    parser = language_id.fit(docs, "doc_id", "text", "lang", 5, 0)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows("documents")}
    for r in got:
        folded = language_id.FOLD[np.frombuffer(texts[r.doc_id], np.uint8)].tobytes()
        lanes = [folded[i : i + language_id.LANE] for i in range(0, len(folded), language_id.LANE)]
        cost = [sum(test_language_id.naive(parser.samples[k], x) for x in lanes) * b for k, b in zip(parser.languages, parser.bits, strict=True)]
        letters = any(c.isalpha() for c in texts[r.doc_id].decode())
        assert r.lang_pred == (parser.languages[int(np.argmin(cost))] if letters else "und"), r.doc_id


def test_op8(spark):
    by = {}
    for r in [*rows("conversations"), *({"conv_id": -7, "turn": i, "role": k, "text": "</s>[INST] ok [/INST]"} for i, k in enumerate(("user", "assistant")))]:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    want = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        want.append((c, len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert sorted(tuple(r)[:5] for r in run(spark, "op8_chat_format")) == sorted(want)


def test_op9(spark):
    held = [r for r in run(spark, "op9_maxent_lm") if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op10(spark):
    items = {r["item_id"]: r["text"] for r in rows("benchmark")}
    found = {(r.doc_id, r.item_id) for r in run(spark, "op10_decontaminate")}
    copies = {(d["doc_id"], i) for d in rows("documents") for i, t in items.items() if t in (d["text"] or "")}
    assert copies <= found
    # every document aligned whole with every item
    tokens = lambda t: words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), wordy=True)[0]
    hashes = {i: tokens(t) for i, t in items.items()}
    want = set()
    for d in rows("documents"):
        mine = tokens(d["text"] or "")
        want |= {(d["doc_id"], i) for i, h in hashes.items() if len(mine) and decontaminate.align(h, mine)[0] >= decontaminate.THRESHOLD * 2 * len(h)}
    assert found == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "x", 0), (10_001, "123 !!", None, None, 6), (10_002, "words of a text that is new", "en", None, 27), (10_002, "words of a text that is new", "en", None, 27)], docs.schema)
    state = docs.union(extra)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, D)
        assert state.columns == docs.columns, name
        state = spark.createDataFrame(state.collect(), docs.schema)
        kept.append(Counter(r.doc_id for r in state.collect()))
    language, near, clean, mixed = kept
    assert set(language) == {r["doc_id"] for r in rows("documents")} | {10_002}
    texts = {r["doc_id"]: r["text"] for r in rows("documents")} | {10_002: "words of a text that is new"}
    brute = test_minhash_dedup.brute([(d, texts[d]) for d in sorted(language)], 5, 80)
    assert near == Counter({d: 1 for d, _, _, keep in brute if keep})
    items = [r["text"] for r in rows("benchmark")]
    assert not any(i in texts[d] for d in clean for i in items) and len(clean) > 0.8 * len(near)
    assert set(mixed) == set(clean) and all(n >= 1 for n in mixed.values())
    last = corpus_pipeline.STAGES[-1][1](spark, state, D).collect()
    assert Counter(r.doc_id for r in last) == mixed


def test_pipeline_with_odd_rows_and_clashing_names(spark):
    """Ids that are null or come again, long and empty texts, and columns named like those the operators use: nothing is lost and no stage fails."""
    text = "some words that make a text long enough to be told from others by its shingles number {}"
    leak = rows("benchmark")[0]["text"]
    data = [(1, text.format("one")), (1, text.format("another one that differs a lot from the first of them")), (None, "a quite different sentence about other matters that nobody wrote down in this table before"), (None, "before it " + leak + " after it"), (2, None), (3, ""), (4, "word " * 60_000), (5, text.format("one"))]
    names = ["lang_pred", "score", "held_out", "row", "n", "slot", "epoch", "block", "position", "__row", "__source", "shard", "old_shard", "size", "id"]
    df = spark.createDataFrame([(d, t, "en", "s", 0, *range(len(names))) for d, t in data], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    state = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, D)
        assert state.columns == df.columns, name
        state = spark.createDataFrame(state.collect(), df.schema)
    kept = state.collect()
    assert all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in kept)
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([data[0], data[1], data[2], data[6]])
    assert len(corpus_pipeline.STAGES[-1][1](spark, state, D).collect()) == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), D).collect() == []
