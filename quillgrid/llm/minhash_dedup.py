"""Near-duplicate classes of documents by an inverted join of MinHash signature coordinates.

A document is the set of its word shingles; its signature holds, for each of N_HASHES hash functions, the least value
in the set. Documents with equal sets form a class first, with a number of its own. Each class
is posted under its coordinate-value pairs. A pair of the wanted similarity agrees in at least
MATCHES(similarity) coordinates, but for a chance below about 1e-5; such a pair must share one of the
N_HASHES - MATCHES + 1 rarest pairs of each (the prefix), all others being skipped, so the lists of frequent passages
are never read. Collisions of candidates are counted on the stored signatures, and those with enough are confirmed on their full shingle sets.

In a list, classes are first compared with one leader, the one that shares most of its signature with
others; then, as far as they are still in different components, with the one that has the fewest shingles of its own. So a family of copies
costs a comparison for each member. Before that second round the shingles of the classes left over are counted: those that no other
of them has cannot be common to a pair, and classes whose remaining shingles are too few for the similarity are left out, which loses none.
What is then still apart meets list by list in blocks of bounded bytes, two blocks at a time: a pair is looked at in the first list that both are in, and not at all once
its ends are known to be connected; only links that connect something new leave a block, so a list gives fewer links than it has members, whatever its pairs.

Defined results: without words or with a null text a document has no shingles, is linked with nothing and kept; rows with an equal
id are one document to components, each with the links of its own text, and each is returned; a null id gets the row (null, ..., component null, kept true) and links nothing;
equal sets are told by 128 bits of hash and their size; texts of any length are whole; ties go to the smallest id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import store
from quillgrid.llm.graph import components, small
from quillgrid.llm.kernels import mix, shingles, words
from quillgrid.llm.store import ids_of, lean, leanly, slices, table, texts_of

N_HASHES = 48
SLICE = 1 << 20
#: With up to this many classes their ids are broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of a block of a list's members, and of a member besides its set.
BLOCK_BYTES, ROW_BYTES = 16 << 20, 8192
FACTORS = mix(np.arange(1, N_HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
SALTS = mix(np.arange(1, N_HASHES + 1, dtype=np.uint64) + np.uint64(1 << 40))


def matches_needed(similarity: float) -> int:
    """Agreeing coordinates below which a pair of this similarity stays with a chance under about 1e-5: the mean less 4.4 deviations."""
    return max(1, math.floor(N_HASHES * similarity - 4.4 * math.sqrt(N_HASHES * similarity * (1 - similarity))))


def sets_of(raw, offsets, width: int):
    """The sorted distinct shingle hashes of each document."""
    for a, b in slices(offsets, SLICE):
        h, _, _, doc = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        s, at = shingles(h, doc, b - a, width)
        for i in range(b - a):
            yield np.unique(s[at[i] : at[i + 1]])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """N_HASHES least values of each set; all ones for an empty set."""
    out = np.full((len(sets), N_HASHES), np.iinfo(np.uint64).max, np.uint64)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        begin = np.zeros(len(full), np.int64)
        np.cumsum([len(sets[i]) for i in full[:-1]], out=begin[1:])
        for k in range(N_HASHES):
            out[full, k] = np.minimum.reduceat(values * FACTORS[k], begin)
    return out


def batches_of_sets(batch: pa.RecordBatch, width: int):
    ids = batch.column(0)
    raw, offsets, _ = texts_of(batch.column(1))
    at, held, size = 0, [], 0
    for s in sets_of(raw, offsets, width):
        held.append(s)
        size += len(s)
        if size > 200_000:
            yield ids.slice(at, len(held)), held
            at, held, size = at + len(held), [], 0
    if held:
        yield ids.slice(at, len(held)), held


SIGNED = "doc_id long, n_shingles long, set_hash long, set_hash2 long, signature array<long>"


def sign(docs: DataFrame, width: int) -> DataFrame:
    """One row per document: size, two hashes of the whole set, and the signature's coordinate-value pairs (empty for an empty set)."""
    arrow = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_hash": pa.int64(), "set_hash2": pa.int64(), "signature": pa.list_(pa.int64())}

    def run(batches):
        for batch in batches:
            for ids, sets in batches_of_sets(batch, width):
                n = np.array([len(s) for s in sets])
                with np.errstate(over="ignore"):
                    h1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                    h2 = np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                values = mix(signatures(sets) ^ SALTS).view(np.int64)[n > 0].ravel()
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, N_HASHES, 0), out=offsets[1:])
                yield table(arrow, [ids, n, h1, h2, pa.ListArray.from_arrays(offsets, pa.array(values))])

    return docs.mapInArrow(leanly(run), SIGNED)


ITEMS = "doc_id long, items binary, signature binary, set_hash long"


def sets_table(docs: DataFrame, reps: DataFrame, wanted: DataFrame, width: int, rows: int) -> DataFrame:
    """rep, the sorted shingle hashes (8 bytes each) and the signature of the classes named in column rep of wanted."""
    arrow = {"doc_id": pa.int64(), "items": pa.binary(), "signature": pa.binary(), "set_hash": pa.int64()}

    def collect(batches):
        for batch in batches:
            for found, sets in batches_of_sets(batch, width):
                h = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield table(arrow, [found, [s.astype("<u8").tobytes() for s in sets], [x.tobytes() for x in signatures(sets)], h])

    few = F.broadcast if rows <= BROADCAST_IDS else (lambda x: x)
    ids = reps.select("rep", F.col("doc").alias("doc_id"), "set_hash").join(few(wanted.select("rep").distinct()), "rep", "left_semi")
    out = docs.join(few(ids.select("doc_id").distinct()), "doc_id", "left_semi").mapInArrow(leanly(collect), ITEMS)
    return out.join(few(ids), ["doc_id", "set_hash"]).dropDuplicates(["rep"]).select("rep", "items", "signature")


def enough(x: np.ndarray, ys: np.ndarray, begin: np.ndarray, percent: int) -> np.ndarray:
    """Whether the set x is similar enough to each of the sets that lie one after another in ys, beginning there."""
    n = np.diff(np.append(begin, len(ys)))
    i = np.minimum(np.searchsorted(x, ys), len(x) - 1)
    common = np.add.reduceat((x[i] == ys).astype(np.int64), begin)
    return 100 * common >= percent * (len(x) + n - common)


def confirm(pairs: DataFrame, items: DataFrame, similarity: float, work) -> DataFrame:
    """Those pairs (a, b) that agree in enough coordinates and whose whole sets are similar enough."""
    percent, least = round(similarity * 100), matches_needed(similarity)

    def compare(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(-1, N_HASHES) for c in ("sig_a", "sig_b"))
            x, y = batch.column("items_a"), batch.column("items_b")
            keep = (sa == sb).sum(axis=1) >= least
            for i in np.flatnonzero(keep):
                keep[i] = enough(np.frombuffer(x[i].as_buffer(), "<u8"), np.frombuffer(y[i].as_buffer(), "<u8"), np.zeros(1, np.int64), percent)[0]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    side = lambda c: items.select(F.col("rep").alias(c), F.col("items").alias(f"items_{c}"), F.col("signature").alias(f"sig_{c}"))
    return work.save(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(leanly(compare), "a long, b long"))


class Block:
    """Members of a list as arrays: numbers, components, sizes, signatures, the lists they are in and their sets."""

    def __init__(self, rows: list[dict], known: dict):
        self.rep = [r["rep"] for r in rows]
        self.of = np.array([known.setdefault(r["component"], len(known)) for r in rows], np.int64)
        self.sets = [np.frombuffer(r["items"], "<u8") for r in rows]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.signature = np.frombuffer(b"".join(r["signature"] for r in rows), "<u8").reshape(-1, N_HASHES)
        self.lists = [np.array(r["lists"], np.int64) for r in rows]


def meet(token: int, x: Block, y: Block, percent: int, least: int, merged: np.ndarray):
    """Links between members of x and y (or of x, if y is x) that connect components not connected before; merged tells where each component has gone."""
    n_lists = np.array([len(t) for t in y.lists], np.int64)
    for i in range(len(x.rep)):
        last = i if y is x else len(y.rep)
        mine, theirs = merged[x.of[i]], merged[y.of[:last]]
        small, large = np.minimum(x.size[i], y.size[:last]), np.maximum(x.size[i], y.size[:last])
        j = np.flatnonzero((theirs != mine) & (100 * small >= percent * large))
        if len(j):
            j = j[(y.signature[j] == x.signature[i]).sum(axis=1) >= least]
        if len(j):
            # a pair that an earlier list has as well is looked at there
            earlier = np.concatenate([y.lists[k] for k in j])
            own = x.lists[i][x.lists[i] < token]
            met = np.add.reduceat(np.isin(earlier, own), np.cumsum(n_lists[j]) - n_lists[j]) if len(own) else np.zeros(len(j), np.int64)
            j = j[met == 0]
        if not len(j):
            continue
        begin = np.cumsum(y.size[j]) - y.size[j]
        for k in j[enough(x.sets[i], np.concatenate([y.sets[k] for k in j]), begin, percent)]:
            a, b = merged[x.of[i]], merged[y.of[k]]
            if a != b:
                merged[merged == b] = a
                yield x.rep[i], y.rep[k]


def settle(members: DataFrame, items: DataFrame, similarity: float, work) -> DataFrame:
    """Links that connect what members (token, rep, component, n_shingles) still leaves apart: block against block within each list."""
    percent, least = round(similarity * 100), matches_needed(similarity)
    weight = F.sum(8 * F.col("n_shingles") + ROW_BYTES)
    lists = work.save(members.groupBy("token").agg(F.ceil(weight / BLOCK_BYTES).cast("int").alias("blocks")))
    own = members.groupBy("rep").agg(F.collect_set("token").alias("lists"))
    dealt = members.select("token", "rep", "component").join(small(lists, lists.count()), "token")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep", "token"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep", "component")
    dealt = dealt.join(items.join(own, "rep"), "rep")

    def run(got: pa.Table) -> pa.Table:
        lean()
        rows, known = got.to_pylist(), {}
        token, x, y = rows[0]["token"], rows[0]["x"], rows[0]["y"]
        one = Block(sorted((r for r in rows if r["mine"] == x), key=lambda r: r["rep"]), known)
        two = Block(sorted((r for r in rows if r["mine"] == y), key=lambda r: r["rep"]), known) if x != y else one
        links = list(meet(token, one, two, percent, least, np.arange(len(known))))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return work.save(dealt.groupBy("token", "x", "y").applyInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links of at least this similarity) and kept (doc_id = component_id)."""
    spark = docs.sparkSession
    work = store.Work(spark, "minhash")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = work.save(sign(docs, width))
    key = ["set_hash", "set_hash2", "n_shingles"]
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature"))
    reps = work.save(classes.withColumn("rep", F.monotonically_increasing_id()))
    rows = reps.count()

    tokens = reps.select("rep", "n_shingles", F.explode("signature").alias("token"))
    frequent = work.save(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    prefix = N_HASHES - matches_needed(similarity) + 1
    shared = tokens.join(frequent, "token").groupBy("rep", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # tokens that no other class has come first in the order of rarity and need no posting
    rarest = F.slice("shared", F.lit(1), F.greatest(F.lit(0), prefix - (N_HASHES - F.size("shared"))))
    postings = shared.select("rep", "n_shingles", (N_HASHES - F.size("shared")).alias("alone"), F.explode(rarest).alias("t"))
    postings = work.save(postings.select("rep", "n_shingles", "alone", F.col("t.token").alias("token")))
    work.drop(frequent)
    work.clean()

    def linked(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b"))
        items = work.save(sets_table(docs, reps, ends, width, rows), compression="none")
        found = confirm(pairs, items, similarity, work)
        work.drop(items)
        work.clean()
        return found

    def apart(members: DataFrame, label: DataFrame) -> DataFrame:
        """Members of lists that hold several components."""
        known = small(label.select(F.col("id").alias("rep"), "component"), label.count())
        found = members.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = found.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        return found.join(mixed, "token")

    pair = [F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")]
    first = F.min(F.struct("alone", F.xxhash64("rep").alias("o"), F.col("rep").alias("leader"))).alias("l")
    leaders = work.save(postings.groupBy("token").agg(first, F.count("*").alias("n")).where("n > 1").select("token", "l.leader"))
    tried = work.save(postings.join(leaders, "token").where("rep <> leader").select(*pair).distinct())
    label = components(linked(tried).union(same_ids(some, reps, key, work)), work)

    members = work.save(apart(postings, label))
    # what the shingles that others of these classes have are at most
    left = work.save(sets_table(docs, reps, members, width, rows), compression="none")
    bounds = work.save(_common(left))
    members = members.join(small(bounds, bounds.count()), "rep").where(100 * F.col("common") >= round(similarity * 100) * F.col("n_shingles"))
    members = work.save(members.select("token", "rep", "component", "n_shingles", "common"))
    order = F.struct((F.col("n_shingles") - F.col("common")).alias("lone"), F.xxhash64("rep").alias("o"), F.col("rep").alias("leader"), F.col("component").alias("of"), F.col("n_shingles").alias("n_leader"), F.col("common").alias("c_leader"))
    leaders = work.save(members.groupBy("token").agg(F.min(order).alias("l"), F.count("*").alias("n")).where("n > 1").select("token", "l.*"))
    pairs = members.join(leaders, "token").where("component <> of").where(_possible("n_shingles", "common", "n_leader", "c_leader", similarity)).select(*pair)
    pairs = work.save(pairs.distinct().join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        label = components(confirm(pairs, left, similarity, work), work, label)
    members = work.save(apart(members.select("token", "rep", "n_shingles"), label))
    if not members.isEmpty():
        label = components(settle(members, left, similarity, work), work, label)
    work.drop(left)
    work.clean()

    named = reps.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*key, "doc", F.coalesce("component", "rep").alias("component"))
    named = work.save(named)
    smallest = named.groupBy("component").agg(F.min("doc").alias("component_id"))
    classes = work.save(named.join(smallest, "component").select(*key, "component_id"))
    work.drop(reps, named)
    plain = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = some.join(classes, key).select("doc_id", "n_shingles", "component_id")
    return out.union(plain).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def same_ids(some: DataFrame, reps: DataFrame, key: list[str], work) -> DataFrame:
    """Links between the classes that rows with one id are in."""
    several = work.save(some.groupBy("doc_id").agg(F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).where("lo <> hi").select("doc_id"))
    mine = some.join(several, "doc_id", "left_semi").join(reps.select(*key, "rep"), key).select("doc_id", "rep").distinct()
    return mine.join(mine.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a < rep").select("a", F.col("rep").alias("b"))


def _common(items: DataFrame) -> DataFrame:
    """rep and common: how many of a set's shingles some other of these sets has as well."""

    def spread(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                raw, offsets, _ = texts_of(part.column(1))
                n = np.diff(offsets) // 8
                yield table({"rep": pa.int64(), "shingle": pa.int64()}, [np.repeat(ids_of(part.column(0)), n), np.frombuffer(raw.tobytes(), "<i8")])

    counted = items.select("rep", "items").mapInArrow(leanly(spread), "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    alone = counted.where("n = 1").groupBy("rep").agg(F.count("*").alias("alone"))
    sizes = items.select("rep", (F.octet_length("items") / 8).cast("long").alias("size"))
    return sizes.join(alone, "rep", "left").select("rep", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _possible(n_a: str, c_a: str, n_b: str, c_b: str, similarity: float):
    """Whether sets of these sizes can be similar enough with no more than the smaller of these counts in common."""
    percent = round(similarity * 100)
    both = F.least(c_a, c_b, n_a, n_b)
    return (100 + percent) * both >= percent * (F.col(n_a) + F.col(n_b))
