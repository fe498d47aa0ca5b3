"""Removal of byte strings that repeat across documents, by a logarithmic family of suffix arrays.

The suffixes that matter are the starts of WIDTH bytes inside one document. Every such window has an
anchor, the K bytes with the least hash in it, and windows in a row with one anchor form a run. Of the WIDTH - K
bytes around an anchor in a window, half or more lie on one side of it; so equal windows have equal anchors with equal
SIDE bytes to the left or to the right. Three rounds of messages between chunks of documents and buckets of anchors settle all windows:

1. Chunks tell buckets their anchors with a byte of hash for either side, and learn which ones another chunk has with an equal side.
2. Of the runs with such an anchor, or one that several documents of the chunk have, chunks tell the hash of all their bytes and the smallest document.
   Equal runs are one from here on: every document but the smallest loses the run. What is left open are runs whose anchor and side
   another, different run has.
3. The bytes of open runs go to the bucket, once for each different run. A bucket takes batches of them; it builds the suffix array of a batch (its WIDTH-byte suffixes in
   the order of their bytes), merge-scans it against the levels that exist for an equal suffix in a document with a smaller id, and adds it as a
   level; levels of equal size merge, so that there are never more than log2(batches) of them.

So a passage costs a few bytes for each chunk that holds it, whatever the documents. Anchors hash to buckets evenly. An anchor with more than
HOT different runs is not gathered: the windows of its runs are told apart by 128 bits of hash in a grouped join over all tasks. Suffixes of arrays are compared byte by
byte; equal runs by 54 bits or more of their anchor and sides and 48 bits of a hash of all their bytes.

Defined results: a null text is empty; a document of fewer than WIDTH bytes keeps all; a text longer than a chunk is a chunk of its own and treated whole; rows with an equal id never
remove each other's bytes; a null id counts as smaller than all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import store
from quillgrid.llm.kernels import mix, powers, prefix, sliding_min, windows
from quillgrid.llm.store import MESSAGE_ARROW, NULL_ID, grouped, pack, read_chunk, slices, table, unpack

WIDTH, K = 50, 24
SIDE = (WIDTH - K) // 2
SLICE = 1 << 20
U = np.uint64
SIDES, RIGHT = U(0xFFFF), U(0xFF)
LOW = U((1 << 24) - 1)
FACTORS = [U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

#: Raw text bytes of a chunk here; chunks that a bucket stands for; suffixes in a batch; different runs of an anchor above which it is not gathered.
CHUNK, PER_BUCKET, BATCH, HOT = 4 << 20, 8, 1 << 18, 20_000
STEP, STEP_ARROW = "kind int, dst long, src long, data binary", {"kind": pa.int32()} | MESSAGE_ARROW
#: Kinds of messages: what a chunk keeps for itself, to buckets, windows of hot anchors.
OWN, ASK, RUN, HOT_WINDOW = 0, 1, 2, 3
RESULT = "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept_sha256 string, kept binary"
RESULT_ARROW = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), "kept_sha256": pa.string(), "kept": pa.binary()}
WINDOW, WINDOW_ARROW = "dst long, start long, id long, a long, b long", {"dst": pa.int64(), "start": pa.int64(), "id": pa.int64(), "a": pa.int64(), "b": pa.int64()}


def suffixes(body: bytes) -> np.ndarray:
    """The WIDTH bytes from every place of body that has as many after it."""
    return np.ndarray((max(0, len(body) - WIDTH + 1),), f"V{WIDTH}", body, strides=(1,))


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes in order, the smallest document of each, and where each given suffix is among them."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(first) - 1
    return keys[first], np.minimum.reduceat(docs[order], np.flatnonzero(first)), where


class SuffixLevels:
    """Suffix arrays of batches in levels, each with the smallest document of every suffix; two levels of about one size merge into the next."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """For each suffix the smallest document in any level; the largest integer where no level has it."""
        docs = np.full(len(keys), np.iinfo(np.int64).max)
        for k, d in self.levels:
            i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            same = k[i] == keys
            docs[same] = np.minimum(docs[same], d[i[same]])
        return docs

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Adds distinct suffixes that are in order."""
        if not len(keys):
            return
        new = keys, docs
        while self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
            old = self.levels.pop()
            new = distinct(*(np.concatenate(x) for x in zip(old, new, strict=True)))[:2]
        self.levels.append(new)


def runs_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor entry, first window, last window and document of each run of windows with one anchor. An entry is a hash of the anchor, its last two bytes replaced by hashes of the SIDE bytes to the left and right (0 where the document has fewer)."""
    found = []
    for a, b in slices(offsets, SLICE):
        part, base = raw[offsets[a] : offsets[b]], offsets[a]
        if len(part) < WIDTH:
            continue
        padded = np.concatenate([part, np.zeros(16, np.uint8)])
        w = np.ndarray((len(part) + 8,), "<u8", padded, strides=(1,)).copy()
        n = len(part) - K + 1
        h = w[:n] * FACTORS[0]
        h += w[8 : 8 + n] * FACTORS[1]
        h += w[16 : 16 + n] * FACTORS[2]
        h ^= h >> U(32)
        h *= FACTORS[3]
        here = np.arange(n, dtype=np.uint64)
        low = sliding_min((h & ~LOW) | (LOW - (here & LOW)), WIDTH - K + 1) & LOW
        start = here[: len(low)]
        anchor = (start + ((LOW - low - start) & LOW)).astype(np.int64)
        lens = np.diff(offsets[a : b + 1])
        ends = np.repeat(offsets[a + 1 : b + 1] - base, lens)[: len(low)]
        ok = np.arange(len(low)) + WIDTH <= ends
        first = ok.copy()
        first[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
        last = ok.copy()
        last[:-1] &= ~ok[1:] | (anchor[1:] != anchor[:-1])
        s0, s1 = np.flatnonzero(first), np.flatnonzero(last)
        doc = np.searchsorted(offsets, s0 + base, "right") - 1
        at = anchor[s0]
        has_left, has_right = at - SIDE >= offsets[doc] - base, at + K + SIDE <= offsets[doc + 1] - base
        # SIDE bytes are two words of eight that overlap
        left = mix(w[np.maximum(at - SIDE, 0)] * FACTORS[0] + w[np.maximum(at - 8, 0)] * FACTORS[1])
        after = np.minimum(at + K, len(part))
        right = mix(w[after] * FACTORS[0] + w[np.minimum(after + SIDE - 8, len(part))] * FACTORS[1])
        # an anchor has the least hash around, so its hash is mixed again before it is dealt to buckets
        entry = mix(h[at]) & ~SIDES
        entry |= np.where(has_left, left >> U(56), U(0)) << U(8)
        entry |= np.where(has_right, right >> U(56), U(0))
        found.append((entry, s0 + base, s1 + base, doc))
    if not found:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sides(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchor with left side, and anchor with right side."""
    return entries & ~RIGHT, entries & ~(SIDES ^ RIGHT)


def hashes_of(raw: np.ndarray, offsets: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """48 bits of hash of byte ranges that lie in one document each and are in order."""
    out = np.empty(len(begin), np.uint64)
    for a, b in slices(offsets, SLICE):
        i, j = np.searchsorted(begin, (offsets[a], offsets[b]))
        if i < j:
            part = raw[offsets[a] : offsets[b]]
            p, (_, down) = prefix(part), powers(len(part) + 1)
            x, y = begin[i:j] - offsets[a], end[i:j] - offsets[a]
            out[i:j] = mix((p[y] - p[x]) * down[x] + (y - x).astype(np.uint64)) >> U(16)
    return out


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(data: bytes, n: int) -> list[np.ndarray]:
    """The arrays of n values that planes() has written one after another."""
    return [np.ascontiguousarray(x.T).reshape(-1).view("<u8").astype(np.uint64) for x in np.frombuffer(data, np.uint8).reshape(-1, 8, n)] if n else []


def in_several(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each key, whether rows with different ids have it."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    several = np.minimum.reduceat(ids[order], begin) < np.maximum.reduceat(ids[order], begin)
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(several, np.diff(np.append(begin, len(keys))))
    return out


def classes(major: np.ndarray, minor: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each pair of major and minor, one place of each class in order, and the smallest id of each."""
    if not len(major):
        z = np.zeros(0, np.int64)
        return z, z, z
    order = np.lexsort((minor, major))
    first = np.ones(len(order), bool)
    first[1:] = (major[order][1:] != major[order][:-1]) | (minor[order][1:] != minor[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(first) - 1
    return of, order[first], np.minimum.reduceat(ids[order], np.flatnonzero(first))


def bounds(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted hashes; a bucket is their first bits."""
    return np.searchsorted(sorted_hashes >> U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def narrowed(entries: np.ndarray, bits: int) -> np.ndarray:
    """What a bucket gets of an entry: 32 more bits of the anchor, and both sides."""
    return ((entries << U(bits)) >> U(32)) << U(16) | entries & SIDES


def expand(s0: np.ndarray, s1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window of the runs, and its run."""
    n = s1 - s0 + 1
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return np.arange(n.sum()) + np.repeat(s0 - (np.cumsum(n) - n), n), of


def covered(length: int, starts: np.ndarray) -> np.ndarray:
    """Which bytes the windows at these starts cover."""
    edge = np.bincount(starts, minlength=length + 1)[: length + 1] - np.bincount(starts + WIDTH, minlength=length + 1)[: length + 1]
    return np.cumsum(edge)[:length] > 0


def results(ids, offsets, raw, removed, keep_text: bool) -> list[tuple]:
    """Rows of RESULT of the documents of a chunk."""
    out = []
    for i, d in enumerate(ids):
        a, b = offsets[i], offsets[i + 1]
        whole = raw[a:b]
        if (gone := removed[a:b]).any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            kept, spans = whole[~gone].tobytes(), [{"begin": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
        else:
            kept, spans = whole.tobytes(), []
        out.append((None if d == NULL_ID else int(d), int(b - a), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
    return out


def as_table(rows: list, arrow: dict) -> pa.Table:
    return pa.Table.from_batches([table(arrow, list(zip(*rows, strict=True)) if rows else [[] for _ in arrow])])


def ints(data, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(data, kind)


def joined(*arrays: np.ndarray) -> bytes:
    """Arrays of integers one after another, each with its length and width in front, compressed."""
    return pack(b"".join(np.array([len(x), x.dtype.itemsize], "<i8").tobytes() + x.tobytes() for x in arrays))


def parted(data) -> list[np.ndarray]:
    data, at, out = unpack(data), 0, []
    while at < len(data):
        n, width = ints(data[at : at + 16])
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16))
        at += 16 + int(n * width)
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Per document: its id, n_bytes, spans (sorted begin and end of each removed run, in bytes of the whole text), kept_sha256 and, if asked for, the kept bytes."""
    spark = docs.sparkSession
    work = store.Work(spark, "suffix")
    chunks = work.save(store.chunked(docs, doc_id, text, CHUNK), compression="none")
    bits = int(np.log2(store.n_buckets(spark, chunks, PER_BUCKET)))
    hot_limit, batch_size = HOT, BATCH

    def send_anchors(batches):
        for batch in batches:
            for chunk, ids, lens, data in zip(*batch.to_pydict().values(), strict=True):
                _, offsets, _, raw = read_chunk(ids, lens, data)
                h = np.unique(runs_of(raw, offsets)[0])
                at = bounds(h, bits)
                full = np.flatnonzero(np.diff(at))
                yield table(MESSAGE_ARROW, [full, np.full(len(full), chunk), [pack(planes(narrowed(h[at[i] : at[i + 1]], bits))) for i in full]])

    def find_shared(got: pa.Table) -> pa.Table:
        lists = []
        for x in got["data"].to_pylist():
            data = unpack(x)
            lists.append(from_planes(data, len(data) // 8)[0])
        shared = [np.zeros(len(x), bool) for x in lists]
        for side in (0, 1):
            values = np.sort(np.concatenate([np.unique(sides(x)[side]) for x in lists]))
            values = np.unique(values[1:][values[1:] == values[:-1]])
            if len(values):
                for x, mark in zip(lists, shared, strict=True):
                    mine = sides(x)[side]
                    mark |= values[np.minimum(np.searchsorted(values, mine), len(values) - 1)] == mine
        rows = [(src, dst, np.packbits(mark).tobytes()) for src, dst, mark in zip(got["src"].to_pylist(), got["dst"].to_pylist(), shared, strict=True) if mark.any()]
        return as_table(rows, MESSAGE_ARROW)

    def opened(got: pa.Table):
        rows = got.to_pylist()
        own = next(r for r in rows if r["src"] == -1)
        return own["dst"], read_chunk(own["ids"], own["lens"], own["data"]), [r for r in rows if r["src"] != -1]

    def send_runs(got: pa.Table) -> pa.Table:
        chunk, (ids, offsets, _, raw), replies = opened(got)
        h, s0, s1, doc = runs_of(raw, offsets)
        unique, inverse = np.unique(h, return_inverse=True)
        remote = np.zeros(len(unique), bool)
        at = bounds(unique, bits)
        for r in replies:
            a, b = at[r["src"]], at[r["src"] + 1]
            remote[a:b] = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=b - a).astype(bool)
        left, right = sides(h)
        keep = remote[inverse] | in_several(left, ids[doc]) | in_several(right, ids[doc])
        if not keep.any():
            return as_table([], STEP_ARROW)
        h, s0, s1, mine = h[keep], s0[keep], s1[keep], ids[doc[keep]]
        key = hashes_of(raw, offsets, s0, s1 + WIDTH)
        of, where, least = classes(h, key, mine)
        out = [(OWN, chunk, -2, joined(s0.astype("<u4"), (s1 - s0).astype("u1"), of.astype("<u4"), (mine > least[of]).astype("u1"), least.astype("<i8").view("<u8"), h[where]))]
        at = bounds(h[where], bits)
        for i in np.flatnonzero(np.diff(at)):
            a, b = at[i], at[i + 1]
            data = planes(narrowed(h[where[a:b]], bits)) + planes(key[where[a:b]]) + planes(least[a:b].view(np.uint64))
            out.append((ASK, int(i), chunk, pack(data)))
        return as_table(out, STEP_ARROW)

    def resolve(got: pa.Table) -> pa.Table:
        """Tells each chunk which of its runs a smaller document has, which are open, and which of them have a hot anchor."""
        lists = []
        for x in got["data"].to_pylist():
            data = unpack(x)
            lists.append(from_planes(data, len(data) // 24))
        entry, key, ids = (np.concatenate([x[i] for x in lists]) for i in range(3))
        ids = ids.view(np.int64)
        of, where, least = classes(entry, key, ids)
        kind = np.arange(len(where))
        left, right = sides(entry[where])
        open_ = in_several(left, kind) | in_several(right, kind)
        _, number, count = np.unique(entry[where] >> U(16), return_inverse=True, return_counts=True)
        removed, need, hot = ids > least[of], open_[of] & (ids == least[of]), count[number][of] > hot_limit
        out, at = [], 0
        for src, dst, x in zip(got["src"].to_pylist(), got["dst"].to_pylist(), lists, strict=True):
            end = at + len(x[0])
            out.append((src, dst, np.packbits(np.concatenate([removed[at:end], need[at:end], hot[at:end]])).tobytes()))
            at = end
        return as_table(out, MESSAGE_ARROW)

    def send_open(got: pa.Table) -> pa.Table:
        """Keeps the starts of removed windows and the places of open runs; sends the bytes of open runs, and of hot ones hashes of their windows."""
        chunk, (ids, offsets, _, raw), replies = opened(got)
        own = next((r for r in replies if r["src"] == -2), None)
        if own is None:
            return as_table([], STEP_ARROW)
        s0, more, of, gone, least, entry = parted(own["data"])
        s0, more, of, least = s0.astype(np.int64), more.astype(np.int64), of.astype(np.int64), least.view(np.int64)
        at = bounds(entry, bits)
        removed, need, hot = (np.zeros(len(least), bool) for _ in range(3))
        for r in replies:
            if r["src"] >= 0:
                a, b = at[r["src"]], at[r["src"] + 1]
                flags = np.unpackbits(np.frombuffer(r["data"], np.uint8), count=3 * (b - a)).astype(bool).reshape(3, -1)
                removed[a:b], need[a:b], hot[a:b] = flags
        out_ = gone.astype(bool) | removed[of]
        rep = ~out_ & need[of]
        out = [(OWN, chunk, -2, joined(s0[out_].astype("<u4"), more[out_].astype("u1"))), (OWN, chunk, -3, joined(of[rep].astype("<u4"), s0[rep].astype("<u4")))]
        # one run of each class, in the order of classes
        runs = np.flatnonzero(rep)
        _, one = np.unique(of[runs], return_index=True)
        runs = runs[one]
        cold = runs[~hot[of[runs]]]
        bucket = np.searchsorted(at, of[cold], "right") - 1
        for part in np.split(cold, np.flatnonzero(np.diff(bucket)) + 1) if len(cold) else []:
            where, _ = expand(s0[part], s0[part] + more[part] + WIDTH - 1)
            data = joined(of[part].astype("<u4"), more[part].astype("u1"), least[of[part]].view(np.uint64), raw[where])
            out.append((RUN, int(np.searchsorted(at, of[part[0]], "right") - 1), chunk, data))
        warm = runs[hot[of[runs]]]
        if len(warm):
            where, lane = expand(s0[warm], s0[warm] + more[warm])
            words = np.ndarray((len(raw) + 8,), "<u8", np.concatenate([raw, np.zeros(16, np.uint8)]), strides=(1,))
            second = np.zeros(len(where), np.uint64)
            for o in (0, 8, 16, 24, 32, 40, WIDTH - 8):
                second = mix(second + words[where + o] * FACTORS[o % 4])
            out.append((HOT_WINDOW, chunk, -4, joined(of[warm][lane].astype("<u4"), (where - s0[warm][lane]).astype("u1"), least[of[warm]][lane].view(np.uint64), windows(raw, WIDTH)[where], second)))
        return as_table(out, STEP_ARROW)

    def match(got: pa.Table) -> pa.Table:
        """The windows of a bucket's open runs that a smaller document has, for each chunk."""
        batches, base = [], 0
        bodies = []
        for src, data in zip(got["src"].to_pylist(), got["data"].to_pylist(), strict=True):
            run, more, ids, body = parted(data)
            lens = more.astype(np.int64) + WIDTH
            begin = np.cumsum(lens) - lens
            at, of = expand(begin, begin + more)
            batches.append((ids.view(np.int64)[of], at + base, np.full(len(at), src), run[of], at - begin[of], windows(body, WIDTH)[at]))
            bodies.append(body.tobytes())
            base += len(body)
        ids, at, src, run, offset, hashes = (np.concatenate(x) for x in zip(*batches, strict=True))
        body = b"".join(bodies)
        del batches, bodies
        # a suffix that only one document has by its hash needs no place in the arrays
        keep = np.flatnonzero(in_several(hashes, ids))
        keep = keep[np.argsort(ids[keep], kind="stable")]
        ids, at, src, run, offset = (x[keep] for x in (ids, at, src, run, offset))
        text, family, hit = suffixes(body), SuffixLevels(), np.zeros(len(ids), bool)
        for a in range(0, len(ids), batch_size):
            b = a + batch_size
            keys, least, where = distinct(text[at[a:b]], ids[a:b])
            # batches come in the order of documents, so a smaller one is in the levels or in the batch
            hit[a:b] = np.minimum(family.scan(keys), least)[where] < ids[a:b]
            family.add(keys, least)
        src, run, offset = src[hit], run[hit], offset[hit]
        order = np.argsort(src, kind="stable")
        out = [(int(src[part[0]]), got["dst"][0].as_py(), joined(run[part], offset[part].astype("u1"))) for part in (np.split(order, np.flatnonzero(np.diff(src[order])) + 1) if len(order) else [])]
        return as_table(out, MESSAGE_ARROW)

    def spread(batches):
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                run, offset, ids, a, b = parted(data)
                yield table(WINDOW_ARROW, [np.full(len(run), chunk), run.astype(np.int64) << 8 | offset, ids.view(np.int64), a.view(np.int64), b.view(np.int64)])

    def gather(got: pa.Table) -> pa.Table:
        start = got["start"].to_numpy()
        return as_table([(got["dst"][0].as_py(), -4, joined((start >> 8).astype("<u4"), (start & 255).astype("u1")))], MESSAGE_ARROW)

    def finish(got: pa.Table) -> pa.Table:
        _, (ids, offsets, _, raw), parts = opened(got)
        starts, reps = [np.zeros(0, np.int64)], None
        for r in parts:
            if r["src"] == -2:
                s0, more = parted(r["data"])
                starts.append(expand(s0.astype(np.int64), s0.astype(np.int64) + more)[0])
            elif r["src"] == -3:
                of, s0 = parted(r["data"])
                order = np.argsort(of, kind="stable")
                reps = of[order], s0[order].astype(np.int64)
        for r in parts:
            if r["src"] not in (-2, -3):
                # every run of the class has these windows
                run, offset = parted(r["data"])
                a, b = np.searchsorted(reps[0], run, "left"), np.searchsorted(reps[0], run, "right")
                at, which = expand(a, b - 1)
                starts.append(reps[1][at] + offset[which])
        return as_table(results(ids, offsets, raw, covered(len(raw), np.concatenate(starts)), keep_text), RESULT_ARROW)

    whole = chunks.select(F.col("chunk").alias("dst"), F.lit(-1).cast("long").alias("src"), F.col("text").alias("data"), "ids", "lens")
    to = lambda steps, *kinds: steps.where(F.col("kind").isin(*kinds)).select("dst", "src", "data")
    with_text = lambda messages: whole.unionByName(messages, allowMissingColumns=True)

    shared = grouped(chunks.mapInArrow(send_anchors, store.MESSAGE), find_shared)
    asked = work.save(grouped(with_text(shared), send_runs, STEP), "kind", compression="none")
    del shared
    work.clean()
    replies = grouped(to(asked, ASK), resolve)
    steps = work.save(grouped(with_text(to(asked, OWN).union(replies)), send_open, STEP), "kind", compression="none")
    del replies
    work.drop(asked)
    work.clean()
    marks = to(steps, OWN).union(grouped(to(steps, RUN), match))
    hot = steps.where(F.col("kind") == HOT_WINDOW).select("dst", "data").mapInArrow(spread, WINDOW)
    least = hot.groupBy("a", "b").agg(F.min("id").alias("least"))
    marks = marks.union(grouped(hot.join(least, ["a", "b"]).where("id > least").select("dst", "start"), gather))
    out = grouped(with_text(marks), finish, RESULT)
    return out if keep_text else out.drop("kept")
