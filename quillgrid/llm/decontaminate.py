"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and bytes beyond ASCII, A-Z as a-z. A first pass counts in how many documents each n-gram of the
test items occurs; an item's seeds are the rarest RAREST of its own n-grams, whatever their counts, so no item is without seeds. In
a second pass every document that holds a seed is aligned with the item around it: the Smith-Waterman score of the words
(match 2, other words and gaps -1) over twice the item's length is 1 for a copy and falls with edits. Both passes only map: documents are never
shuffled. Test items are taken in blocks of BLOCK_ITEMS, so what the tasks get has a bound.

An item of fewer than SEED words is its own seed. Where a window holds several copies of an item, what lies before and after the best one is aligned again, so each gives a row.

Defined results: null texts and items without words match nothing; equal ids give rows of their own; equal items all match; of alignments that score alike the first one counts;
texts of any length are searched whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import kernels
from quillgrid.llm.kernels import shingles, words
from quillgrid.llm.store import leanly, ship, slices, table, texts_of

SEED, THRESHOLD, BLOCK_ITEMS, SLICE, BITS = 3, 0.4, 20_000, 1 << 20, 20
#: The part of an item's n-grams, the rarest ones, that are its seeds.
RAREST = 0.75
LEAK = "doc_id long, item_id long, score double, begin_word long, end_word long"
LEAK_ARROW = {"doc_id": pa.int64(), "item_id": pa.int64(), "score": pa.float64(), "begin_word": pa.int64(), "end_word": pa.int64()}


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the end of it in text."""
    n = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros(len(text) + 1, np.int64)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, 2, -1), row[1:] - 1)
        # a gap costs 1 a word: the best of all places to the left, less the distance
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + n) - n, 0)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


class Seeds:
    """Item n-grams, sorted, with the items and offsets they occur at."""

    def __init__(self, ids: list, texts: list):
        raw = b"".join(t.encode() for t in texts)
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        h, _, _, doc = words(np.frombuffer(raw, np.uint8), offsets, wordy=True)
        self.ids, self.items = ids, [h[doc == i] for i in range(len(texts))] if len(texts) < 50 else np.split(h, np.searchsorted(doc, np.arange(1, len(texts))))
        grams, item, at = [], [], []
        self.widths = sorted({SEED} | {min(len(w), SEED) for w in self.items if len(w)})
        for i, w in enumerate(self.items):
            if len(w):
                g, _ = shingles(w, np.zeros(len(w), np.int64), 1, min(len(w), SEED))
                grams.append(g)
                item.append(np.full(len(g), i))
                at.append(np.arange(len(g)))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self._take(join(grams, np.uint64), join(item, np.int64), join(at, np.int64))

    def _take(self, grams: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.posted, self.item, self.at = grams[order], item[order], at[order]
        self.grams = np.unique(self.posted)
        self.first = np.searchsorted(self.posted, self.grams)
        self.last = np.searchsorted(self.posted, self.grams, "right")
        self.map = np.zeros(1 << BITS, bool)
        self.map[(self.grams >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def keep_rarest(self, df: np.ndarray) -> None:
        """Keeps of each item the n-grams that are not more frequent than its RAREST quantile."""
        mine = df[np.searchsorted(self.grams, self.posted)]
        keep = np.zeros(len(mine), bool)
        order = np.argsort(self.item, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(self.item[order])) + 1) if len(order) else []:
            keep[part] = mine[part] <= np.quantile(mine[part], RAREST)
        self._take(self.posted[keep], self.item[keep], self.at[keep])

    def hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among n-grams s that are seeds, and which."""
        where = np.flatnonzero(self.map[(s >> np.uint64(64 - BITS)).astype(np.int64)])
        if not len(where) or not len(self.grams):
            return where[:0], where[:0]
        i = np.minimum(np.searchsorted(self.grams, s[where]), len(self.grams) - 1)
        ok = self.grams[i] == s[where]
        return where[ok], i[ok]


def documents(batches, seeds: Seeds):
    """Ids, words' hashes and their offsets of slices of documents, and for each n-gram that is a seed: document, place in it, and which seed."""
    for batch in batches:
        ids = batch.column(0).to_pylist()
        raw, offsets, _ = texts_of(batch.column(1))
        for a, b in slices(offsets, SLICE):
            h, _, _, doc = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], wordy=True)
            found = []
            for width in seeds.widths:
                s, s_at = shingles(h, doc, b - a, width)
                where, gram = seeds.hits(s)
                of = np.searchsorted(s_at, where, "right") - 1
                found.append((of, where - s_at[of], gram))
            yield ids[a:b], h, np.searchsorted(doc, np.arange(b - a + 1)), *(np.concatenate(x) for x in zip(*found, strict=True))


def passages(item: np.ndarray, text: np.ndarray, threshold: float):
    """Score, begin and end of the copies of an item in a text, the best one of each stretch first."""
    stretches = [(0, len(text))]
    while stretches:
        lo, hi = stretches.pop()
        if hi <= lo:
            continue
        score, end = align(item, text[lo:hi])
        if score >= threshold * 2 * len(item):
            _, back = align(item[::-1], text[lo : lo + end][::-1])
            yield score / (2 * len(item)), lo + end - back, lo + end
            stretches += [(lo, lo + end - back), (lo + end, hi)]


def leaks_of(seeds: Seeds, h, h_at, of, place, gram, threshold: float):
    """document, item, score, begin and end of every leak in a slice."""
    if not len(gram):
        return
    n = seeds.last[gram] - seeds.first[gram]
    post = np.repeat(seeds.first[gram], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    doc, item = np.repeat(of, n), seeds.item[post]
    diagonal = np.repeat(place, n) - seeds.at[post]
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal = doc[order], item[order], diagonal[order]
    new = np.ones(len(doc), bool)
    sizes = np.array([len(w) for w in seeds.items])
    pads = sizes // 2 + 4
    same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])
    new[1:] = ~(same & (diagonal[1:] - diagonal[:-1] <= (sizes + 2 * pads)[item[1:]]))
    begin = np.flatnonzero(new)
    for i, j in zip(begin, np.append(begin[1:], len(doc)) - 1, strict=True):
        d, k = doc[i], item[i]
        mine = h[h_at[d] : h_at[d + 1]]
        lo = max(0, int(diagonal[i]) - pads[k])
        hi = min(len(mine), int(diagonal[j]) + sizes[k] + pads[k])
        for score, first, end in passages(seeds.items[k], mine[lo:hi], threshold):
            yield d, seeds.ids[k], score, lo + first, lo + end


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each passage of a document that is a copy, edited or not, of a test item: doc_id, item_id, score (0 to 1) and the passage's first word and end."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    blocks = -(-items.count() // BLOCK_ITEMS)
    out = spark.createDataFrame([], LEAK)
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.collect()
        seeds = Seeds([r["item_id"] for r in rows], [r["text"] for r in rows])
        kernels.forget()  # else the tables of powers would travel with every task
        load = ship(spark, seeds)

        def count(batches, load=load):
            known = load()
            total = np.zeros(len(known.grams), np.int64)
            for ids, _, _, of, _, gram in documents(batches, known):
                pairs = np.unique(gram * np.int64(len(ids)) + of)
                total += np.bincount(pairs // len(ids), minlength=len(total))
            full = np.flatnonzero(total)
            yield table({"gram": pa.int64(), "n": pa.int64()}, [full, total[full]])

        df = np.zeros(len(seeds.grams), np.int64)
        for r in docs.mapInArrow(leanly(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
            df[r["gram"]] = r["n"]
        seeds.keep_rarest(df)
        load = ship(spark, seeds)

        def search(batches, load=load):
            chosen = load()
            for ids, *found in documents(batches, chosen):
                found = [(ids[d], item, score, int(b), int(e)) for d, item, score, b, e in leaks_of(chosen, *found, threshold)]
                if found:
                    yield table(LEAK_ARROW, list(zip(*found, strict=True)))

        out = out.union(docs.mapInArrow(leanly(search), LEAK)) if block else docs.mapInArrow(leanly(search), LEAK)
    return out
