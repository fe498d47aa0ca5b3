"""Resharding with the fewest bytes moved, as a minimum-cost flow.

Rows lie in old shards; the new shards must hold counts at most one apart (the law `rows`). An even share is the whole part of rows / shards,
and as many shards as rows are left over take one row more. Of an old shard that stays, the largest rows up to an even share stay in any case, the
next one may stay or go at the cost of its size, and all others go; of a shard that is given up all rows go. The cheapest flow tells which shards keep that
one row more and how many rows each shard takes in, so the fewest bytes move. The network has three arcs for an old shard and three for a new one, so
it is solved on the driver whatever the number of rows. What goes is told by a few cuts in the order of the rows (size, then a number each row has of its own),
so texts move once, to the shard they are written to; ids may be null or come again.

Defined results: a null text has size 1 and the checksum of the empty text; rows with an equal id are rows of their own; a null id is hashed like any other;
fewer rows than shards leave shards empty; an empty table gives an empty result; texts of any length move whole;
equally large rows go in the order of their numbers; other columns go into the files, but for those called old_shard, shard or slot, which the files have anew.
"""

from __future__ import annotations

import heapq
import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm import store
from quillgrid.llm.ranks import ranked

OLD_SHARDS, SHARDS = 12, 16
#: Bytes or rows of a part of a shard, in which slots are counted; tables of up to this many parts a shard are broadcast.
PART_BYTES, PART_ROWS, MOST_PARTS = 16 << 20, 1 << 18, 4096
COLUMNS = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]


class FlowNetwork:
    """Minimum-cost flow by successive shortest paths with potentials; costs are not negative."""

    def __init__(self):
        self.arcs: dict[object, list[int]] = {}
        self.to, self.room, self.cost = [], [], []

    def arc(self, a, b, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs.setdefault(x, []).append(len(self.to))
            self.arcs.setdefault(y, [])
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def solve(self, source, sink) -> None:
        potential = dict.fromkeys(self.arcs, 0.0)
        self.arcs.setdefault(source, [])
        while True:
            far, via, queue, n = {source: 0.0}, {}, [(0.0, 0, source)], 0
            while queue:
                d, _, x = heapq.heappop(queue)
                if d > far[x]:
                    continue
                for e in self.arcs[x]:
                    if self.room[e] > 0:
                        y, new = self.to[e], d + max(0.0, self.cost[e] + potential[x] - potential[self.to[e]])
                        if new < far.get(y, float("inf")) - 1e-9:
                            n += 1
                            far[y], via[y] = new, e
                            heapq.heappush(queue, (new, n, y))
            if sink not in far:
                return
            for x, d in far.items():
                potential[x] += d
            most, x = float("inf"), sink
            while x != source:
                most, x = min(most, self.room[via[x]]), self.to[via[x] ^ 1]
            x = sink
            while x != source:
                self.room[via[x]] -= most
                self.room[via[x] ^ 1] += most
                x = self.to[via[x] ^ 1]


def transfers(shares: dict[int, tuple[int, int]], shards: int) -> tuple[dict[int, int], list[int]]:
    """From each old shard's rows, and the size of the row that comes after its largest rows up to an even share: the rows that each keeps, and the rows each new shard takes in, with the fewest bytes moved."""
    total = sum(n for n, _ in shares.values())
    even = total // shards
    net, stay, into = FlowNetwork(), {}, []
    for old, (n, size) in sorted(shares.items()):
        keep = min(n, even) if old < shards else 0
        next_ = int(n > even) if old < shards else 0
        net.arc("source", ("largest", old), keep, 0)
        net.arc("source", ("next", old), next_, 0)
        net.arc("source", "moved", n - keep - next_, 0)
        stay[old] = [net.arc(("largest", old), ("new", old), keep, 0), net.arc(("next", old), ("new", old), next_, 0)]
        net.arc(("next", old), "moved", next_, size)
    for j in range(shards):
        into.append(net.arc("moved", ("new", j), total, 0))
        net.arc(("new", j), "sink", even, 0)
        net.arc(("new", j), "extra", 1, 0)
    net.arc("extra", "sink", total % shards, 0)
    net.solve("source", "sink")
    return {old: sum(map(net.flow, e)) for old, e in stay.items()}, [net.flow(e) for e in into]


def hashed_shard(doc_id: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("old")), F.lit(shards)).cast("int")


def numbered(docs: DataFrame, old_shard: Column, doc_id: str, text: str, work, copy: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with a number of their own (__row) and the input in a struct, and the facts that place them."""
    saved = store.numbered(docs, work, old_shard.cast("int").alias("old_shard"), copy=copy)
    rows = saved.select(F.col("n").alias("__row"), "old_shard", F.col("row").alias("doc"))
    if hasattr(saved, "saved_path"):
        rows.saved_path = saved.saved_path
    text = F.col("doc")[text].cast("string")
    return rows, rows.select(
        "__row",
        "old_shard",
        F.col("doc")[doc_id].alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
    )


class Placement:
    """Where the rows of facts (old_shard, size, __row) go: their shard by cuts, their slot by counts of small parts of a shard."""

    def __init__(self, facts: DataFrame, shards: int, work):
        self.spark, self.work = facts.sparkSession, work
        counts = {r["old_shard"]: (r["n"], r["bytes"]) for r in facts.groupBy("old_shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
        total = sum(n for n, _ in counts.values())
        self.parts = max(1, math.ceil(sum(b for _, b in counts.values()) / shards / PART_BYTES), math.ceil(total / shards / PART_ROWS))
        order = facts.select("old_shard", (-F.col("size")).alias("less"), "__row")
        order = work.save(ranked(order, ["old_shard"], ["less", "__row"], "nth", work))
        at = {r["old_shard"]: -r["less"] for r in order.where(F.col("nth") == total // shards).collect()}
        keep, into = transfers({old: (n, at.get(old, 0)) for old, (n, _) in counts.items()}, shards)
        # the rows that go are numbered shard after shard, and each new shard takes a run of these numbers
        ends, first = list(itertools.accumulate(into)), 0
        cuts = []
        for old, kept in sorted(keep.items()):
            n = counts[old][0]
            if kept:
                cuts.append((old, kept - 1, old))
            last = first + n - kept
            cuts += [(old, kept + min(end, last) - first - 1, j) for j, end in enumerate(ends) if max(first, end - into[j]) < min(end, last)]
            first = last
        self.changed = sorted({old for old, kept in keep.items() if kept < counts[old][0]} | {j for j, n in enumerate(into) if n})
        self.filled = {j for _, _, j in cuts}
        wanted = F.broadcast(self.spark.createDataFrame(cuts, "old_shard int, nth long, shard int"))
        found = order.join(wanted, ["old_shard", "nth"]).groupBy("old_shard").agg(F.sort_array(F.collect_list(F.struct("less", "__row", "shard"))).alias("cuts"))
        self.cuts = work.save(found)
        work.drop(order)
        sizes = self.dealt(facts.select("old_shard", "size", "__row")).groupBy("shard", "__part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        self.sizes = work.save(sizes.select("shard", "__part", F.coalesce(before, F.lit(0)).alias("before")))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows with shard and __part, which is a part of the shard by the row's number."""
        key = F.struct((-F.col("size")).alias("less"), F.col("__row"))
        to = F.filter("cuts", lambda c: key <= F.struct(c["less"].alias("less"), c["__row"]))[0]["shard"]
        part = F.pmod(F.xxhash64("__row"), F.lit(self.parts)).alias("__part")
        return rows.join(F.broadcast(self.cuts), "old_shard").withColumn("shard", to).drop("cuts").withColumn("__part", part)

    def place(self, rows: DataFrame) -> DataFrame:
        """rows (with old_shard, size and __row) with shard and slot."""
        nth = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("__row")) - 1
        # a row for each part of a shard, PART_BYTES or PART_ROWS of the input
        before = F.broadcast(self.sizes) if self.parts <= MOST_PARTS else self.sizes
        found = self.dealt(rows).withColumn("nth", nth).join(before, ["shard", "__part"])
        return found.withColumn("slot", (F.col("before") + F.col("nth")).cast("long")).drop("before", "nth", "__part")


def old_shards(doc_id: str, old_shard: Column | None) -> Column:
    return hashed_shard(F.col(doc_id), OLD_SHARDS) if old_shard is None else old_shard


def reshard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", old_shard: Column | None = None, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (0, 1, ... within the shard) of every row. old_shard is where rows lie now; without it, a hash over OLD_SHARDS."""
    work = store.Work(docs.sparkSession, "reshard")
    rows, facts = numbered(docs, old_shards(doc_id, old_shard), doc_id, text, work)
    facts = work.save(facts)
    work.drop(rows)
    return Placement(facts, shards, work).place(facts).select(*COLUMNS)


def changed(assigned: DataFrame) -> list[int]:
    gone = assigned.where("old_shard <> shard").select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct()
    return sorted(r["s"] for r in gone.collect())


def placed(docs: DataFrame, assigned: DataFrame, shards: list[int], key: str) -> DataFrame:
    """Rows of docs that lie in these new shards, with their old_shard, shard and slot."""
    into = assigned.where(F.col("shard").isin(shards)).select(F.col(key if key in assigned.columns else "doc_id").alias(key), "old_shard", "shard", "slot")
    return docs.select(*[c for c in docs.columns if c not in ("old_shard", "shard", "slot")]).join(into, key)


def write_shards(rows: DataFrame, shards: list[int], filled: set[int], path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(path)
    spark = rows.sparkSession
    for s in set(shards) - filled:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={s}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def filled(assigned: DataFrame) -> set[int]:
    return {r["shard"] for r in assigned.select("shard").distinct().collect()}


def rewrite(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> list[int]:
    """Writes the shards that lose or take in rows, as folders shard=N under path, rows by slot; files of the others stay, those of a shard left empty go. key must be unique and not null. Gives the shards changed."""
    shards = changed(assigned)
    if shards:
        write_shards(placed(docs, assigned, shards, key).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot"), shards, filled(assigned), path)
    return shards


def reshard_files(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", old_shard: Column | None = None, shards: int = SHARDS, path: str | None = None) -> DataFrame:
    """Assigns rows as reshard does, writes the changed shards (under path, else in the shared folder) and gives the columns of reshard as the files have them; rows of unchanged shards stay as they are."""
    spark = docs.sparkSession
    work = store.Work(spark, "shards")
    # the files under path may be those that docs is read from
    rows, facts = numbered(docs, old_shards(doc_id, old_shard), doc_id, text, work, copy=path is not None)
    facts = work.save(facts)
    where = Placement(facts, shards, work)
    if not where.changed:
        return where.place(facts).select(*COLUMNS)
    size = (F.coalesce(F.octet_length(F.col("doc")[text].cast("string")), F.lit(0)) + 1).cast("long")
    texts = where.place(rows.withColumn("size", size)).where(F.col("shard").isin(where.changed))
    path = path or f"{work.root}/files"
    write_shards(texts.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c not in ("old_shard", "shard", "slot")], "old_shard", "slot", "shard"), where.changed, where.filled, path)
    work.drop(rows)
    files = spark.read.parquet(path).where(F.col("shard").isin(where.changed))
    found = files.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_crc32"),
        "old_shard",
        F.col("shard").cast("int").alias("shard"),
        "slot",
    )
    stay = set(range(shards)) - set(where.changed)
    if not stay:
        return found.select(*COLUMNS)
    return found.select(*COLUMNS).union(where.place(facts).where(F.col("shard").isin(sorted(stay))).select(*COLUMNS))
