"""Language identification by cross-parsing: how few phrases of a language's sample make up a text.

A suffix automaton of each language's sample accepts all its substrings. A text is cut greedily into the longest phrases
that a sample holds; phrases times log2 of the sample's size, over the text's length, estimates the cross entropy, and the language
with the least wins. Texts are parsed in lanes of LANE bytes side by side, a numpy step for a byte of all lanes.

The automata come from a bounded sample (parameters SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES, TOTAL_BYTES) of the labelled
training rows, picked by a hash; every text is parsed whole, however long.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the first language in byte order; without any labelled
training row every text is `und`; an empty table gives an empty result; other columns are ignored. A null id is never held out, and trains nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from quillgrid.llm.store import leanly, ship, slices, table, texts_of

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_BYTES, TOTAL_BYTES = 64, 600, 24_000, 400_000
LANE, SLICE = 512, 2 << 20

#: Bytes as the automata see them: lower case, digits as 0, white space as a blank, other ASCII signs as a full stop.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:128] = ord(".")
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[48:58] = ord("0")
FOLD[[32, *range(9, 14)]] = 32
ALPHA = np.zeros(256, bool)
ALPHA[65:91] = ALPHA[97:123] = True


def automaton(sample: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sample; state 0 is the root."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in sample:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


class CrossParser:
    """The automata of all languages as dense tables."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        folded = {lang: FOLD[np.frombuffer(samples[lang], np.uint8)] for lang in self.languages}
        self.samples = {lang: x.tobytes() for lang, x in folded.items()}
        seen = np.unique(np.concatenate([*folded.values(), np.zeros(0, np.uint8)]))
        self.width = len(seen) + 1
        self.codes = np.zeros(256, np.int32)
        self.codes[seen] = np.arange(1, self.width)
        self.codes = self.codes[FOLD]
        self.tables, self.bits = [], []
        for lang in self.languages:
            states = automaton(folded[lang].tobytes())
            code = np.zeros(256, np.int32)
            code[seen] = np.arange(1, self.width)
            moves = np.full(len(states) * self.width, -1, np.int32)
            for i, to in enumerate(states):
                for c, j in to.items():
                    moves[i * self.width + code[c]] = j * self.width
            self.tables.append(moves)
            self.bits.append(np.log2(len(folded[lang]) + 1))

    def phrases(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each document in each language."""
        lens = np.diff(offsets)
        lanes = -(-lens // LANE)
        doc = np.repeat(np.arange(len(lens)), lanes)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[:-1][doc] + k * LANE
        size = np.minimum(LANE, offsets[1:][doc] - start)
        order = np.argsort(-size, kind="stable")
        start, size, doc = start[order], size[order], doc[order]
        active = np.searchsorted(-size, -np.arange(LANE), "left")
        code = self.codes[raw]
        out = np.zeros((len(lens), len(self.languages)))
        for j, moves in enumerate(self.tables):
            first = np.maximum(moves[: self.width], 0)
            state, ended = np.zeros(len(start), np.int32), np.ones(len(start), np.int32)
            for t in range(int(size[0]) if len(size) else 0):
                n = active[t]
                c = code[start[:n] + t]
                to = moves[state[:n] + c]
                stop = to < 0
                ended[:n] += stop
                state[:n] = np.where(stop, first[c], to)
            out[:, j] = np.bincount(doc, ended, len(lens))
        return out

    def predict(self, raw: np.ndarray, offsets: np.ndarray, null: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(null)
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(ALPHA[raw], out=letters[1:])
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
            has[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        cost = self.phrases(raw, offsets) * np.array(self.bits)
        best = cost.argmin(axis=1)
        least = cost[np.arange(n), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - cost, -60) / 8).sum(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, has, strict=True)], np.where(has, score, 0.0)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, folds: int, fold: int) -> CrossParser:
    """Learns from labelled rows outside the fold; the driver gets at most about 2 * SAMPLE_DOCS texts of SAMPLE_CHARS characters a language."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0) & (fold_of(F.col(doc_id), folds) != fold))
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id), F.lit(1 << 40)).alias("order"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return CrossParser({})
    share = F.create_map(*[F.lit(x) for lang_, n in counts.items() for x in (lang_, int(min(1.0, 2 * SAMPLE_DOCS / n) * (1 << 40)))])
    rows = known.where(F.col("order") <= share[F.col("lang")]).select("lang", "order", F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()
    most = min(SAMPLE_BYTES, TOTAL_BYTES // len(counts))
    samples: dict[str, bytes] = {lang_: b"" for lang_ in counts}
    for r in sorted(rows, key=lambda r: (r["lang"], r["order"], r["text"])):
        if len(samples[r["lang"]]) < most:
            samples[r["lang"]] += r["text"].encode()[: most - len(samples[r["lang"]])] + b"\n"
    return CrossParser({k: v for k, v in samples.items() if v.strip()})


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, fold: int = 0, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, after the columns named in carry; those called like a column of the result are left out (pack them into a struct to keep them). The text goes to the workers once, even if it is carried."""
    spark = docs.sparkSession
    load = ship(spark, fit(docs, doc_id, text, lang, folds, fold))
    carry = [c for c in carry or [] if c not in ("held_out", "lang_pred", "score")]
    own = text in carry and docs.schema[text].dataType == StringType()
    places = {c: f"c{i}" for i, c in enumerate(carry) if not (own and c == text)}
    # the carried columns travel in a struct, so that their names can't clash
    kept = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("id"), F.struct(F.lit(0).alias("_0"), *[F.col(c).alias(at) for c, at in places.items()]).alias("carry"))

    def run(batches):
        parser = load()
        for batch in batches:
            raw, offsets, null = texts_of(batch.column(0))
            for a, b in slices(offsets, SLICE):
                pred, score = parser.predict(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], null[a:b])
                part = batch.slice(a, b - a)
                columns = [part.column(i) for i in range(0 if own else 1, 3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=sent.names)

    sent = StructType(kept.schema.fields[0 if own else 1 :]).add("lang_pred", "string").add("score", "double")
    out = kept.mapInArrow(leanly(run), sent)
    held = F.coalesce(fold_of(F.col("id"), folds) == fold, F.lit(False))
    return out.select(*[(F.col("carry")[places[c]] if c in places else F.col("text")).alias(c) for c in carry], *([] if doc_id in carry else [F.col("id").alias(doc_id)]), held.alias("held_out"), "lang_pred", "score")
