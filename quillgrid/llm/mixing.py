"""Mixing sources to target weights by Pfair scheduling; DataFrame and SQL functions only.

Each source's rows, in the order of a hash, make blocks of BLOCK rows. With integer weights a of sum P, the k-th block of a source is released at
slot floor(k P / a) and due by slot ceil((k + 1) P / a); in every slot the released block with the earliest deadline goes out (ties: the source first
in order). Such a schedule exists and keeps each source within less than one block of its share at every slot; it repeats after P slots. So one
period is scheduled, in one row of bounded size, and every block finds its slot from its number alone.

The stream ends when every source has been through once: no row is lost, and sources that run out before go round again (epochs 1, 2, ...).

Defined results: null sources are a source of their own; a null id sorts first; rows with an equal id or equal rows are rows of their own; sources without a given weight
have weight 1; an empty table gives an empty result; texts of any length go as they are; columns of the input are kept, but for those called like a column of the result, which the result has anew (a caller that needs them packs them into a struct).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLOTS, POWER = 16, 1000, 0.8
RESULT = ("epoch", "block", "slot", "position")
#: Rows of the source table up to which it is broadcast.
BROADCAST_SOURCES = 20_000


#: Sources that a number in the schedule has room for.
MOST_SOURCES = 1 << 20


def schedule(weights: Column) -> Column:
    """For an array of integer weights, the index of the source that each slot of a period goes to, by earliest deadline first.

    Releases and slots are sorted into one list of events; a fold over it keeps the released blocks that wait, as numbers in the order of deadline and source."""
    slot = F.lit((1 << 63) - 1)
    start = F.struct(F.array().cast("array<long>").alias("waiting"), F.array().cast("array<int>").alias("out"))

    def step(state, event):
        served = lambda w: F.struct(F.slice(w, 2, F.size(w)).alias("waiting"), F.concat(state["out"], F.array((w[0] % MOST_SOURCES).cast("int"))).alias("out"))
        released = F.struct(F.concat(state["waiting"], F.array(event["key"])).alias("waiting"), state["out"].alias("out"))
        return F.when(event["key"] == slot, once(F.sort_array(state["waiting"]), served)).otherwise(released)

    def fold(known):
        period = known["period"]

        def blocks(a, i):
            due = lambda k: F.ceil((k + 1) * period / a).cast("long") * MOST_SOURCES + i
            return F.transform(F.sequence(F.lit(0).cast("long"), a - 1), lambda k: F.struct(F.floor(k * period / a).cast("long").alias("t"), due(k).alias("key")))

        slots = F.transform(F.sequence(F.lit(0).cast("long"), period - 1), lambda t: F.struct(t.alias("t"), slot.alias("key")))
        events = F.sort_array(F.concat(F.flatten(F.transform(known["weights"], blocks)), slots))
        return F.aggregate(events, start, step, lambda s: s["out"])

    period = F.aggregate(weights, F.lit(0).cast("long"), lambda s, x: s + x)
    return once(F.struct(weights.alias("weights"), period.alias("period")), fold)


def once(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def plan(docs: DataFrame, source: str, weights: dict[str | None, int] | None = None, block: int = BLOCK, slots: int = SLOTS, power: float = POWER) -> DataFrame:
    """A row per source: __source, __a (weight), __period, __blocks, __total (blocks scheduled until all sources are through) and __slots (of its blocks in a period).

    Without weights, a source's weight is its number of rows to the power, in parts of slots."""
    name = F.col(source).cast("string")
    counts = docs.groupBy(name.alias("__source")).agg(F.count("*").alias("__rows"))
    if weights is None:
        share = F.pow(F.col("__rows"), F.lit(power))
        a = F.greatest(F.lit(1), F.round(slots * share / F.sum(share).over(Window.partitionBy()))).cast("long")
    else:
        known = [F.when(F.col("__source").eqNullSafe(F.lit(k)), F.lit(int(w))) for k, w in weights.items()]
        a = F.coalesce(*known, F.lit(1)).cast("long")
    counts = counts.withColumn("__a", a).withColumn("__blocks", F.ceil(F.col("__rows") / block).cast("long"))
    listed = counts.groupBy().agg(F.sort_array(F.collect_list(F.struct("__source", "__a", "__blocks"))).alias("list")).where(F.size("list") > 0)
    # exploded, as a projection would be merged with the next one and compute the schedule for every slot again
    listed = listed.select("list", F.explode(F.array(schedule(F.transform("list", lambda x: x["__a"])))).alias("slot_of"))
    named = F.transform("slot_of", lambda x, t: F.struct(t.cast("long").alias("t"), F.size("slot_of").cast("long").alias("__period"), F.element_at("list", x + 1).alias("s")))
    taken = listed.select(named.alias("named")).select(F.explode("named").alias("e")).select("e.*")
    each = taken.groupBy("s", "__period").agg(F.sort_array(F.collect_list("t")).alias("__slots")).select("s.*", "__period", "__slots")
    last = slot_of_block(F.col("__blocks") - 1)
    end = F.max(last).over(Window.partitionBy())
    within = F.size(F.filter("__slots", lambda t: t <= F.col("end") % F.col("__period")))
    return each.withColumn("end", end).withColumn("__total", F.expr("end div __period") * F.col("__a") + within).drop("end")


def slot_of_block(q: Column) -> Column:
    return F.floor(q / F.col("__a")) * F.col("__period") + F.element_at("__slots", (q % F.col("__a") + 1).cast("int"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str | None, int] | None = None, block: int = BLOCK, slots: int = SLOTS, power: float = POWER) -> DataFrame:
    """The rows of docs, each as often as the schedule takes its block, with columns epoch, block, slot and position (of the row in the mixed stream)."""
    sources = plan(docs, source, weights, block, slots, power)
    # the input travels in a struct, so that its names can't clash with those in use here;
    # a key that is never null, so that numbering and both joins share one shuffle
    name = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    others = F.xxhash64(*[F.col(c) for c in docs.columns])
    # a source's order is that of the hash, so its rows are numbered in small groups of equal hash prefix
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), name(F.col(source).cast("string")).alias("__source"), key.alias("__key"), F.substring(key, 1, 3).alias("__part"), F.col(doc_id).alias("__id"), others.alias("__others"))
    parts = docs.select(name(F.col(source).cast("string")).alias("__source"), F.substring(key, 1, 3).alias("__part")).groupBy("__source", "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__source", "__part", before.alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__source", "__part").orderBy("__key", "__id", "__others")) - 1
    rows = keyed.withColumn("__nth", nth).join(parts, ["__source", "__part"])
    sources = sources.withColumn("__source", name(F.col("__source")))
    rows = rows.join(F.broadcast(sources) if sources_bounded(docs, source) else sources, "__source")
    rank = F.col("__nth") + F.col("__before")
    rows = rows.withColumn("__rank", rank).withColumn("__block", F.floor(F.col("__rank") / block))
    epochs = F.floor((F.col("__total") - 1 - F.col("__block")) / F.col("__blocks"))
    rows = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    rows = rows.withColumn("__slot", slot_of_block(F.col("__block") + F.col("__epoch") * F.col("__blocks")))
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c not in RESULT]
    return rows.select(*kept, F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__slot").alias("slot"), (F.col("__slot") * block + F.col("__rank") % block).alias("position"))


def sources_bounded(docs: DataFrame, source: str) -> bool:
    return docs.select(source).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def oracle(block: int = BLOCK, slots: int = SLOTS, power: float = POWER) -> str:
    """The mix of table documents in DuckDB's SQL, each slot of the period found by recursion."""
    return f"""
WITH RECURSIVE counted AS (
  SELECT source, count(*) AS n, CAST(ceil(count(*) / {block}.0) AS BIGINT) AS blocks, pow(count(*), {power}) AS share FROM documents GROUP BY source
), weighed AS (
  SELECT source, n, blocks, CAST(greatest(1, round({slots} * share / sum(share) OVER ())) AS BIGINT) AS a,
    CAST(row_number() OVER (ORDER BY source NULLS FIRST) AS INT) AS i FROM counted
), listed AS (SELECT list(a ORDER BY i) AS a, CAST(sum(a) AS BIGINT) AS period FROM weighed),
run(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS INT) FROM listed
  UNION ALL
  SELECT t + 1, list_transform(done, lambda k, i: k + CASE WHEN i = nxt THEN 1 ELSE 0 END), CAST(nxt AS INT) FROM (
    SELECT t, done, list_min(list_filter(list_transform(done, lambda k, i:
        CASE WHEN k * period < (t + 2) * a[i] THEN -((-(k + 1) * period) // a[i]) * 100000 + i END), lambda d: d IS NOT NULL)) % 100000 AS nxt, period
    FROM run, listed WHERE t + 1 < period)
), sched AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM run WHERE t >= 0),
ends AS (
  SELECT max(((w.blocks - 1) // w.a) * l.period + s.t) AS last FROM weighed w, listed l, sched s WHERE s.i = w.i AND s.j = (w.blocks - 1) % w.a
), totals AS (
  SELECT w.*, l.period, (e.last // l.period) * w.a + (SELECT count(*) FROM sched s WHERE s.i = w.i AND s.t <= e.last % l.period) AS total FROM weighed w, listed l, ends e
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS r FROM documents
), copies AS (
  SELECT d.doc_id, d.source, d.r, w.i, w.a, w.period, w.blocks, d.r // {block} AS block,
    unnest(range(0, (w.total - 1 - d.r // {block}) // w.blocks + 1)) AS epoch
  FROM ranked d JOIN totals w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT c.doc_id, c.source, CAST(c.epoch AS BIGINT) AS epoch, CAST(c.block AS BIGINT) AS block,
  CAST(((c.block + c.epoch * c.blocks) // c.a) * c.period + s.t AS BIGINT) AS slot,
  CAST((((c.block + c.epoch * c.blocks) // c.a) * c.period + s.t) * {block} + c.r % {block} AS BIGINT) AS position
FROM copies c JOIN sched s ON s.i = c.i AND s.j = (c.block + c.epoch * c.blocks) % c.a
"""
