"""Language-model scores of documents by a hashed maximum-entropy model with a class-factored softmax.

Counting covers every training token: chunks send buckets of the hash space their distinct words with counts, buckets
add them up and answer every chunk that asked, and the classes' totals come from the same sums. No task and no broadcast holds the
vocabulary. A word's class is the octave of its count, and a hash deals the words of a class to SUBS subclasses; the class of unknown words holds the one slot that the
base estimate gives them. The model is log P(class | history) + log P(subclass | class, history) + log P(word | subclass). The first two are softmaxes that start
from the shares of tokens and learn weights of hashed features of the history - the previous word, the word before it (skip)
and both together; for the second one the previous word and both, joined with the class; the last is the word's share of its subclass. A frequent word has a subclass of its own or nearly so, thus
its distribution within the class is learned word by word. In training, a token's class is that of its count without itself, so that words seen once teach what unknown words look like.

The weights are fitted on every training token, once each: a hash deals the chunks to ROUNDS rounds. In a round, groups of its chunks start from the current weights, make sparse minibatch
gradient updates and return the rows they changed in blocks; a row's new value is the mean over the groups that
met it, weighted by how often, so that what only one group sees is learned in full. The tables of weights grow with the square root of the distinct features (words are counted, pairs estimated
from the least hashes), and the groups of a round with the square root of its chunks; each worker holds the whole tables. Documents are dealt to chunks, and chunks to rounds and groups, by hashes of
their content, so scores depend on the rows alone and not on how they are partitioned.

Defined results: a null or blank text is one token, the end; the rows of an equal id are scored one by one; a null id
counts as the empty text in the hold-out rule; a text longer than a chunk is a chunk of its own and scored whole; counts that tie share a class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import store
from quillgrid.llm.kernels import mix, words
from quillgrid.llm.store import MESSAGE_ARROW, NULL_ID, grouped, pack, read_chunk, slices, table, unpack
from quillgrid.llm.suffix_dedup import as_table, bounds

SLICE = 1 << 20
CLASSES, SUBS, TABLE = 64, 16, 4096
ROUNDS, BATCH, RATE = 4, 4096, 0.5
#: Largest size of a sum of weights before its exponential.
MOST = np.float32(60)
#: Raw bytes of a partition of documents, which holds two chunks or so.
PART = 2 * store.CHUNK_BYTES
#: Rows of the weight table in a block; hashes kept for the estimate of distinct pairs.
BLOCK, LEAST = 1024, 256
END = np.uint64(0x2545F4914F6CDD1D)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_ARROW = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
COUNTED = "dst long, src long, data binary, mass array<long>, types array<long>"
COUNTED_ARROW = MESSAGE_ARROW | {"mass": pa.list_(pa.int64()), "types": pa.list_(pa.int64())}


def held_out(ids: np.ndarray, folds: int, fold: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NULL_ID else str(i).encode()) % folds == fold for i in ids.tolist()], bool)


def stream(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of documents one after another, each with its end, and the documents' offsets among them."""
    h, _, _, doc = words(raw, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n) + 1
    at = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=at[1:])
    out = np.full(at[-1], END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, at


def numbered_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
    """The distinct words of a chunk, and for each slice its first and last document, tokens, their offsets, and the tokens as numbers of distinct words: every token is hashed and sorted once."""
    parts, own = [], []
    for a, b in slices(offsets, SLICE):
        t, at = stream(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        u, inverse = np.unique(t, return_inverse=True)
        parts.append((a, b, t, at, inverse))
        own.append(u)
    u, inverse = np.unique(np.concatenate(own), return_inverse=True)
    ends = np.cumsum([len(x) for x in own])
    return u, [(a, b, t, at, inverse[end - len(x) : end][mine]) for (a, b, t, at, mine), x, end in zip(parts, own, ends.tolist(), strict=True)]


def class_of(count: np.ndarray) -> np.ndarray:
    """0 for words that were not counted, else 1 and up by the octave of the count."""
    return np.where(count > 0, np.minimum(CLASSES - 1, 1 + np.floor(np.log2(np.maximum(count, 1)))), 0).astype(np.int64)


def sub_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % SUBS


def histories(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token's previous word, the word before it, both together."""
    before = np.full(len(tokens), END, np.uint64)
    before[1:] = tokens[:-1]
    before[at[:-1]] = END
    skip = np.full(len(tokens), END, np.uint64)
    skip[1:] = before[:-1]
    skip[at[:-1]] = END
    return before, skip, mix(before * np.uint64(3) + skip)


def hashed(hashes: list[np.ndarray], sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Rows of a weight table for each token's features."""
    return [(x >> np.uint64(20)).astype(np.int64) % n + sum(sizes[:i]) for i, (x, n) in enumerate(zip(hashes, sizes, strict=True))]


def within_class(hashes: list[np.ndarray], kind: np.ndarray) -> list[np.ndarray]:
    """The previous word, and both words together, each joined with the token's class."""
    return [mix(x + (kind.astype(np.uint64) << np.uint64(56))) for x in (hashes[0], hashes[2])]


def table_rows(distinct: float) -> int:
    """Rows for so many distinct features."""
    return max(TABLE, 1 << int(np.ceil(np.log2(4 * np.sqrt(max(distinct, 1))))))


def least(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes)[:LEAST]


def distinct_of(hashes: np.ndarray) -> float:
    """Estimated number of distinct hashes, from the least ones of all."""
    return len(hashes) if len(hashes) < LEAST else (LEAST - 1) * 2.0**64 / float(hashes[LEAST - 1])


def exponentials(weights: np.ndarray, rows: list[np.ndarray], prior) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the sums of weights over the features of each token, and their totals. Sums beyond MOST count as MOST, so that nothing overflows."""
    out = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        out += weights.take(r, axis=0)
    out += weights[-1] + prior
    np.minimum(out, MOST, out=out)
    np.maximum(out, -MOST, out=out)
    np.exp(out, out=out)
    return out, out @ np.ones(out.shape[1], out.dtype)


def log_softmax(weights: np.ndarray, rows: list[np.ndarray], prior=0.0) -> np.ndarray:
    out, total = exponentials(weights, rows, prior)
    return np.log(out) - np.log(total)[:, None]


def log_chosen(weights: np.ndarray, rows: list[np.ndarray], prior, target: np.ndarray) -> np.ndarray:
    """log_softmax at the target of each token."""
    out, total = exponentials(weights, rows, prior)
    return np.log(out[np.arange(len(out)), target]) - np.log(total)


def log_share(mass: np.ndarray, least: float) -> np.ndarray:
    """Logarithms of shares along the last axis; what has no mass counts as least."""
    mass = np.maximum(mass, least)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log(mass / mass.sum(axis=-1, keepdims=True)), nan=0.0, neginf=-1e4).astype(np.float32)


class Learner:
    """A table of weights (a row for each hashed feature, the last one for the bias) with the size of its past gradients and how many tokens met each row."""

    def __init__(self, start: np.ndarray):
        self.start, self.weights = start, start.copy()
        self.past, self.hits = np.full(len(start), 1e-6, np.float32), np.zeros(len(start), np.int64)

    def descend(self, rows: list[np.ndarray], target: np.ndarray, prior: np.ndarray) -> None:
        """A sparse update by one minibatch, each row's rate falling with the size of its past gradients."""
        wrong, total = exponentials(self.weights, rows, prior)
        wrong *= (1 / total)[:, None]
        wrong.reshape(-1)[np.arange(len(wrong)) * wrong.shape[1] + target] -= 1
        for r in rows:
            key = np.sort(r * BATCH + np.arange(len(r)))
            order, key = key % BATCH, key // BATCH
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            grad, row = np.add.reduceat(wrong.take(order, axis=0), begin), key[begin]
            self.past[row] += np.einsum("ij,ij->i", grad, grad)
            self.hits[row] += np.diff(begin, append=len(r))
            self.weights[row] -= grad * (RATE / np.sqrt(self.past[row]))[:, None]
        grad = wrong.sum(axis=0)
        self.past[-1] += (grad * grad).sum()
        self.hits[-1] += len(wrong)
        self.weights[-1] -= RATE * grad / np.sqrt(self.past[-1])

    def changes(self):
        """First row, change and hits of each block that was met."""
        for a in range(0, len(self.weights), BLOCK):
            n = self.hits[a : a + BLOCK]
            if n.any():
                yield a, (self.weights[a : a + BLOCK] - self.start[a : a + BLOCK]).astype("<f2"), n


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """A row per document (columns of SCORED): scores are log10 probabilities of the whole text; documents whose crc32(id as text) mod folds is fold are held out of all learning."""
    spark = docs.sparkSession
    work = store.Work(spark, "maxent")
    chunks = work.save(store.chunked(store.dealt_by_content(docs, doc_id, text, PART)), compression="none")
    work.clean()
    bits = int(np.log2(store.n_buckets(spark, chunks, 32)))

    def send_counts(batches):
        for batch in batches:
            for chunk, ids, lens, data in zip(*batch.to_pydict().values(), strict=True):
                ids, offsets, _, raw = read_chunk(ids, lens, data)
                u, parts = numbered_words(raw, offsets)
                n = sum(np.bincount(word, np.repeat(~held_out(ids[a:b], folds, fold), np.diff(at)), len(u)) for a, b, _, at, word in parts).astype(np.int64)
                at = bounds(u, bits)
                full = np.flatnonzero(np.diff(at))
                yield table(MESSAGE_ARROW, [full, np.full(len(full), chunk), [pack(u[at[i] : at[i + 1]].tobytes() + n[at[i] : at[i + 1]].astype("<u8").tobytes()) for i in full]])

    def add_up(got: pa.Table) -> pa.Table:
        lists = [np.frombuffer(unpack(x), "<u8").reshape(2, -1) for x in got["data"].to_pylist()]
        u, inverse = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        at = 0
        for x in lists:
            np.add.at(total, inverse[at : at + x.shape[1]], x[1].astype(np.int64))
            at += x.shape[1]
        kind = class_of(total) * SUBS + sub_of(u)
        mass, types = np.bincount(kind, total, CLASSES * SUBS).astype(np.int64), np.bincount(kind, total > 0, CLASSES * SUBS).astype(np.int64)
        rows, at = [(-1, got["dst"][0].as_py(), None, mass.tolist(), types.tolist())], 0
        for src, x in zip(got["src"].to_pylist(), lists, strict=True):
            rows.append((src, got["dst"][0].as_py(), pack(total[inverse[at : at + x.shape[1]]].astype("<u8").tobytes()), None, None))
            at += x.shape[1]
        return as_table(rows, COUNTED_ARROW)

    counted = work.save(chunks.mapInArrow(send_counts, store.MESSAGE).groupBy("dst").applyInArrow(add_up, COUNTED), compression="none")
    work.clean()
    totals = counted.where("dst = -1").select(F.posexplode(F.arrays_zip("mass", "types"))).groupBy("pos").agg(F.sum("col.mass").alias("mass"), F.sum("col.types").alias("types")).collect()
    mass = np.zeros(CLASSES * SUBS)
    for r in totals:
        mass[r["pos"]] = r["mass"]
    mass = mass.reshape(CLASSES, SUBS)
    n_train, n_types = sum(r["mass"] for r in totals), sum(r["types"] for r in totals)
    # above the highest class that holds tokens, all are empty
    classes = int(np.flatnonzero(mass.sum(axis=1)).max(initial=0)) + 1
    # softmaxes start from these; unknown words as if they were as many as those seen once
    in_all = mass[:classes].sum(axis=1)
    in_all[0] = in_all[min(1, classes - 1)]
    prior, prior_within = log_share(in_all, 1), log_share(mass[:classes], 1)
    # a subclass without words has no part in scores
    share_within = np.where(mass[:classes] > 0, log_share(mass[:classes], 0), np.float32(-1e4))
    answers = counted.where("dst >= 0").select("dst", "src", "data")
    whole = chunks.select(F.col("chunk").alias("dst"), F.lit(-1).cast("long").alias("src"), F.col("text").alias("data"), "ids", "lens")

    def looked_up(got: pa.Table):
        """The distinct words of a chunk with their counts, and for each slice ids, tokens, offsets and the tokens as numbers of words."""
        rows = got.to_pylist()
        own = next(r for r in rows if r["src"] == -1)
        ids, offsets, _, raw = read_chunk(own["ids"], own["lens"], own["data"])
        u, parts = numbered_words(raw, offsets)
        total = np.concatenate([np.frombuffer(unpack(r["data"]), "<u8") for r in sorted(rows, key=lambda r: r["src"]) if r["src"] >= 0]).astype(np.int64)
        return u, total, [(ids[a:b], t, at, word) for a, b, t, at, word in parts]

    examples_arrow = {"chunk": pa.int64(), "words": pa.binary(), "kinds": pa.binary(), "tokens": pa.binary(), "lens": pa.binary(), "least": pa.binary()}

    def examples(got: pa.Table) -> pa.Table:
        """The training documents of a chunk: its words with their classes, the tokens as numbers of words (two lower bytes, then the upper ones), and the least hashes of pairs."""
        u, total, parts = looked_up(got)
        tokens, numbers, lens = [], [], []
        for ids, t, at, word in parts:
            learn = ~held_out(ids, folds, fold)
            use = np.repeat(learn, np.diff(at))
            tokens.append(t[use])
            numbers.append(word[use])
            lens.append(np.diff(at)[learn])
        t, number, lens = np.concatenate(tokens), np.concatenate(numbers), np.concatenate(lens)
        if not len(t):
            return as_table([], examples_arrow)
        here = np.bincount(number, minlength=len(u)) > 0
        u, inverse = u[here], (np.cumsum(here) - 1)[number]
        pairs = histories(t, np.concatenate(([0], np.cumsum(lens))))[2]
        planes = (inverse & 0xFFFF).astype("<u2").tobytes() + (inverse >> 16).astype("<u2").tobytes()
        return as_table([(got["dst"][0].as_py(), u.tobytes(), class_of(total[here] - 1).astype("u1").tobytes(), pack(planes), lens.astype("<i8").tobytes(), least(pairs).tobytes())], examples_arrow)

    sizes, sizes_within = (TABLE, TABLE, TABLE), (TABLE, TABLE)
    zeros = lambda n, width: np.zeros((sum(n) + 1, width), np.float32)
    weights = [zeros(sizes, classes), zeros(sizes_within, SUBS)]
    if n_train:
        schema = "chunk long, words binary, kinds binary, tokens binary, lens binary, least binary"
        learned = work.save(whole.unionByName(answers, allowMissingColumns=True).groupBy("dst").applyInArrow(examples, schema), compression="none")
        work.clean()

        def merge_least(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([least(np.frombuffer(b"".join(batch["least"].to_pylist()), "<u8")).tobytes()])], names=["least"])

        pairs = least(np.frombuffer(b"".join(r[0] for r in learned.select("least").mapInArrow(merge_least, "least binary").collect()), "<u8"))
        sizes = (table_rows(n_types), table_rows(n_types), table_rows(distinct_of(pairs)))
        sizes_within = (2 * sizes[0], 2 * sizes[2])
        weights = [zeros(sizes, classes), zeros(sizes_within, SUBS)]
        chosen = learned.withColumn("round", F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)))
        of_round = {r["round"]: r["count"] for r in chosen.groupBy("round").count().collect()}
        for round_, n_chunks in sorted(of_round.items()):
            groups = min(n_chunks, int(4 * np.ceil(np.sqrt(n_chunks))))
            weights = _round(spark, chosen.where(F.col("round") == round_), groups, weights, sizes, sizes_within, prior, prior_within)
            work.clean()
        work.drop(learned)
        work.clean()
    model = spark.sparkContext.broadcast(weights)

    def score_chunk(got: pa.Table) -> pa.Table:
        out = []
        _, total, parts = looked_up(got)
        for ids, t, at, word in parts:
            count = total[word]
            base = np.log10((count + 1) / (n_train + 1.0 * (n_types + 1)))
            kind, sub, known = np.minimum(class_of(count), classes - 1), sub_of(t), count > 0
            mine = np.zeros(len(t))
            mine[known] = np.log(count[known] / mass[kind[known], sub[known]])
            hashes = histories(t, at)
            rows = hashed(hashes, sizes)
            for a in range(0, len(t), BATCH):
                mine[a : a + BATCH] += log_chosen(model.value[0], [r[a : a + BATCH] for r in rows], prior, kind[a : a + BATCH])
            where = np.flatnonzero(known)
            rows = hashed(within_class([x[where] for x in hashes], kind[where]), sizes_within)
            for a in range(0, len(where), BATCH):
                here = where[a : a + BATCH]
                mine[here] += log_chosen(model.value[1], [r[a : a + BATCH] for r in rows], share_within[kind[here]], sub[here])
            mine /= np.log(10)
            add = lambda x: np.add.reduceat(x, at[:-1])
            out += zip([None if i == NULL_ID else i for i in ids.tolist()], held_out(ids, folds, fold).tolist(), np.diff(at).tolist(), add(known.astype(np.int64)).tolist(), [n_train] * len(ids), add(base).tolist(), add(mine).tolist(), strict=True)
        return as_table(out, SCORED_ARROW)

    return whole.unionByName(answers, allowMissingColumns=True).groupBy("dst").applyInArrow(score_chunk, SCORED)


def _round(spark, chosen: DataFrame, groups: int, weights: list, sizes: tuple, sizes_within: tuple, prior: np.ndarray, prior_within: np.ndarray) -> list:
    """The weights after one round over these chunks in so many groups."""
    shared = spark.sparkContext.broadcast(weights)
    arrow = {"part": pa.int64(), "block": pa.int64(), "grp": pa.int64(), "delta": pa.binary(), "hits": pa.binary()}
    widths = [w.shape[1] for w in weights]

    def learn(learners, u, kinds, tokens, lens):
        low, high = np.frombuffer(unpack(tokens), "<u2").reshape(2, -1).astype(np.int64)
        which = low + (high << 16)
        t, kind = np.frombuffer(u, "<u8")[which], np.frombuffer(kinds, "u1").astype(np.int64)[which]
        kind = np.minimum(kind, widths[0] - 1)
        hashes = histories(t, np.concatenate(([0], np.cumsum(np.frombuffer(lens, "<i8")))))
        rows, where = hashed(hashes, sizes), np.flatnonzero(kind)
        inner = hashed(within_class([x[where] for x in hashes], kind[where]), sizes_within)
        sub = sub_of(t[where])
        for a in range(0, len(t), BATCH):
            learners[0].descend([r[a : a + BATCH] for r in rows], kind[a : a + BATCH], prior)
        for a in range(0, len(where), BATCH):
            learners[1].descend([r[a : a + BATCH] for r in inner], sub[a : a + BATCH], prior_within[kind[where[a : a + BATCH]]])

    def update(batches):
        learners, group = None, None

        def out():
            for part, learner in enumerate(learners):
                for a, delta, n in learner.changes():
                    yield table(arrow, [[part], [a], [group], [delta.tobytes()], [n.astype("<i8").tobytes()]])

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "words", "kinds", "tokens", "lens")), strict=True):
                if g != group:
                    if learners:
                        yield from out()
                    learners, group = [Learner(w) for w in shared.value], g
                learn(learners, *row)
        if learners:
            yield from out()

    def average(got: pa.Table) -> pa.Table:
        part, total, n = got["part"][0].as_py(), 0.0, 0
        for r in sorted(got.to_pylist(), key=lambda r: r["grp"]):
            hits = np.frombuffer(r["hits"], "<i8")
            total = total + np.frombuffer(r["delta"], "<f2").reshape(-1, widths[part]).astype(np.float64) * hits[:, None]
            n = n + hits
        return as_table([(part, got["block"][0].as_py(), (total / np.maximum(n, 1)[:, None]).astype("<f4").tobytes())], {"part": pa.int64(), "block": pa.int64(), "delta": pa.binary()})

    dealt = chosen.select(F.pmod(F.xxhash64("chunk", F.lit("group")), F.lit(groups)).alias("grp"), "chunk", "words", "kinds", "tokens", "lens")
    dealt = dealt.repartition(groups, "grp").sortWithinPartitions("grp", "chunk")
    deltas = dealt.mapInArrow(update, "part long, block long, grp long, delta binary, hits binary")
    weights = [w.copy() for w in weights]
    for r in deltas.groupBy("part", "block").applyInArrow(average, "part long, block long, delta binary").collect():
        delta = np.frombuffer(r["delta"], "<f4").reshape(-1, widths[r["part"]])
        weights[r["part"]][r["block"] : r["block"] + len(delta)] += delta
    shared.unpersist()
    return weights
