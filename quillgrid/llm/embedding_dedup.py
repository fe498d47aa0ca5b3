"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact reranking.

Iterative quantisation learns, on a bounded sample (SAMPLE vectors picked by hash), a rotation of the principal axes whose signs lose
least, so codes are balanced; ROTATIONS of them start from different random rotations. A code is cut into chunks; two vectors are candidates if in
some chunk their codes differ in at most one bit. One half of the chunk is equal then, so every vector is posted twice for a chunk, under each of its halves, and the partition that
holds a half looks the vectors up under the one-bit neighbours of the other half in a sorted array. Candidates within MOST_BITS of each other's whole code are compared by cosine in double precision. Equal vectors of a label are one class before all this.

Chunks get longer with the number of vectors (at least 8 bits), so that lists stay short; bits that don't make a whole chunk make no table. There are as many rotations
as it takes for a pair just at the threshold to meet in some chunk with a chance of RECALL, whatever the length of chunks, if each of its bits differs with the chance that a random plane parts it.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label, link with nothing; vectors of different length do not link; rows with
an equal id are a row each, and one vertex; a null id is linked with nothing and kept; vectors of any length are compared whole; ties go to the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import store
from quillgrid.llm.graph import components
from quillgrid.llm.store import table

SAMPLE, ROTATIONS, ROUNDS, MOST_BITS = 4096, 2, 30, 22
LEAST_WIDTH, MOST_WIDTH, RECALL = 8, 30, 0.97
#: Postings of a partition, and pairs of codes that are compared at once.
POSTED, AT_ONCE = 400_000, 1 << 20


def vectors_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Each list as the bytes of doubles, null where it can't be compared, and its length."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    offsets = np.asarray(column.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = np.ascontiguousarray(column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64))
    offsets = offsets - offsets[0]
    count = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])
    ok = (count(~np.isfinite(flat)) == 0) & (count(flat != 0) > 0) & ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    whole = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets * 8), pa.py_buffer(flat)])
    return pc.if_else(pa.array(ok), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary()), np.diff(offsets)


def tables_of(width: int, bits: int, cosine: float) -> list[tuple[int, int, int]]:
    """Rotation, first bit and width of each table."""
    cuts = [(a, width) for a in range(0, bits - width + 1, width)] or [(0, bits)]
    p, w = math.acos(cosine) / math.pi, cuts[0][1]
    met = (1 - p) ** w + w * p * (1 - p) ** (w - 1)
    rotations = max(ROTATIONS, math.ceil(math.log(1 - RECALL) / math.log(1 - min(met, 1 - 1e-9)) / len(cuts)))
    return [(r, a, w) for r in range(rotations) for a, w in cuts]


class Quantiser:
    """Balanced binary codes of directions: centred, on principal axes, rotated so that signs lose least."""

    def __init__(self, sample: np.ndarray, rotations: int = ROTATIONS):
        self.mean = sample.mean(axis=0)
        x = sample - self.mean
        bits = min(64, sample.shape[1])
        # the whole basis of the vectors' space, but not that of the sample, which is larger
        _, _, axes = np.linalg.svd(x, full_matrices=len(x) < x.shape[1])
        axes = axes[:bits].T
        self.maps = []
        for k in range(rotations):
            turn, _ = np.linalg.qr(np.random.default_rng(k).normal(size=(bits, bits)))
            v = x @ axes
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
                turn = (u @ w).T
            self.maps.append(axes @ turn)
        self.bits = bits

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A signed 64-bit code for each vector and rotation."""
        place = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return np.stack([(((x - self.mean) @ m >= 0) * place).sum(axis=1, dtype=np.uint64).view(np.int64) for m in self.maps], axis=1)


def flips_of(width: int, side: int) -> list[int]:
    """Differences that a posting looks up: those in the lower half of the chunk and none where the upper half is equal (side 0), and those in the upper half."""
    return [0, *(1 << j for j in range(width // 2))] if side == 0 else [1 << j for j in range(width // 2, width)]


def meetings(keys: np.ndarray, flips: list[int]):
    """Places (i, j) of pairs of sorted keys that differ by one of flips, each pair once, at most AT_ONCE or one key's pairs at a time."""
    for flip in flips:
        at = np.flatnonzero(keys & np.uint64(flip) == 0) if flip else np.arange(len(keys))
        want = keys[at] | np.uint64(flip)
        first = np.searchsorted(keys, want, "left") if flip else at + 1
        n = np.searchsorted(keys, want, "right") - first
        at, first, n = at[n > 0], first[n > 0], n[n > 0]
        ends = np.concatenate(([0], np.cumsum(n)))
        for a, b in store.slices(ends, AT_ONCE):
            inside = np.arange(ends[b] - ends[a]) - np.repeat(ends[a:b] - ends[a], n[a:b])
            yield np.repeat(at[a:b], n[a:b]), np.repeat(first[a:b], n[a:b]) + inside


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / np.sqrt((v * v).sum())


def similar_vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links (other vectors found with at least this cosine and the same label), component_id (smallest id reachable) and kept, for every row."""
    spark = embeddings.sparkSession
    work = store.Work(spark, "itq")
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))

    def encode(batches):
        for batch in batches:
            v, dim = vectors_of(batch.column(1))
            yield table({"vec_id": pa.int64(), "label": pa.string(), "v": pa.binary(), "dim": pa.int32()}, [batch.column(0), batch.column(2), v, dim])

    every = work.save(rows.mapInArrow(encode, "vec_id long, label string, v binary, dim int"))
    usable = every.where("v IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL")
    classes = work.save(usable.groupBy("label", "v", "dim").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("n")))
    links = None
    for dim, count in [(r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()]:
        found = _pairs(spark, classes.where(F.col("dim") == dim), count, cosine, work)
        links = found if links is None else links.union(found)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    sizes = classes.select("rep", "n")
    both = links.union(links.select(F.col("b"), F.col("a")))
    more = both.join(sizes.select(F.col("rep").alias("b"), "n"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    label_of = components(links, work)
    classes = classes.join(more, "rep", "left").join(label_of.select(F.col("id").alias("rep"), "component"), "rep", "left")
    classes = work.save(classes.select("label", "v", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = usable.join(classes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = every.where("v IS NULL OR label IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _pairs(spark, classes: DataFrame, count: int, cosine: float, work) -> DataFrame:
    """Pairs (a, b), a < b, of class representatives that the tables find and whose cosine is large enough."""
    # the least hashes: only about as many rows as are wanted are sent, not as many from each task
    order, share = F.xxhash64("v", "label"), min(1.0, (SAMPLE + 10 * math.sqrt(SAMPLE)) / max(count, 1))
    sample = classes.where(order <= min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63))).orderBy(order).limit(SAMPLE).select("v").collect()
    sample = np.stack([unit(np.frombuffer(r["v"], "<f8")) for r in sample])
    width = int(np.clip(np.ceil(np.log2(max(2, count))), LEAST_WIDTH, MOST_WIDTH))
    tables = tables_of(width, min(64, sample.shape[1]), cosine)
    rotations = tables[-1][0] + 1
    load = store.ship(spark, Quantiser(sample, rotations))

    def code(batches):
        learned = load()
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(batch.num_rows, -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                codes = learned.codes(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(codes), pa.list_(pa.int64()))], names=["rep", "label", "codes"])

    coded = work.save(classes.select("rep", "label", "v").mapInArrow(code, "rep long, label string, codes array<long>"))
    chunk = lambda r, a, w: F.shiftrightunsigned(F.element_at("codes", r + 1), a).bitwiseAND(F.lit((1 << w) - 1))
    halves = [(chunk(r, a + w // 2, w - w // 2), chunk(r, a, w // 2)) for r, a, w in tables]
    posted = F.explode(F.array(*[F.struct(F.lit(2 * i + side).alias("slot"), k.alias("half")) for i, both in enumerate(halves) for side, k in enumerate(both)])).alias("p")
    parts = max(store.partitions(spark), math.ceil(2 * len(tables) * count / POSTED))
    posted = coded.select("rep", "label", "codes", posted).select("rep", "label", "codes", "p.*").repartition(parts, "label", "slot", "half").drop("half")

    def meet(batches):
        store.lean()
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        rep, slot = got["rep"].to_numpy(), got["slot"].to_numpy()
        label = got["label"].combine_chunks().dictionary_encode()
        label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy().astype(np.uint64)
        codes = got["codes"].combine_chunks().flatten().to_numpy().reshape(-1, rotations).view(np.uint64)
        del got, batches
        for s in np.unique(slot):
            r, first, w = tables[s // 2]
            at = np.flatnonzero(slot == s)
            keys = (label[at] << np.uint64(w)) | (codes[at, r] >> np.uint64(first)) & np.uint64((1 << w) - 1)
            order = np.argsort(keys)
            at, keys = at[order], keys[order]
            for i, j in meetings(keys, flips_of(w, s % 2)):
                i, j = at[i], at[j]
                near = np.bitwise_count(codes[i] ^ codes[j]).min(axis=1) <= MOST_BITS
                a, b = rep[i[near]], rep[j[near]]
                a, b = np.minimum(a, b), np.maximum(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a[a < b]), pa.array(b[a < b])], names=["a", "b"])

    near = posted.mapInArrow(meet, "a long, b long").distinct()
    v = classes.select("rep", "v")

    def compare(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<f8").reshape(batch.num_rows, -1) for c in ("va", "vb"))
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                c = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                keep = pa.array(c >= cosine)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    near = work.save(near)
    pairs = near.join(v.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b")
    return work.save(pairs.select("a", "b", "va", "vb").mapInArrow(compare, "a long, b long"))
