"""Positions of rows within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], order: list, name: str, work) -> DataFrame:
    """df with a column name: 0, 1, ... within each value of keys, in the given order.

    Rows are dealt by ranges of keys and order, so a large group is spread over tasks; each task numbers its own rows, and what a group has in
    earlier tasks is added. That table has a row for each task, and one more for each group that begins in it, and is broadcast, so groups must be few (shards, say).
    """
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    saved = work.save(dealt.withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33).alias("__task")
    parts = saved.groupBy(*keys, task).agg(F.min("__at").alias("__lo"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "__task", "__lo", F.coalesce(before, F.lit(0)).alias("__before"))
    out = saved.withColumn("__task", F.shiftright("__at", 33)).join(F.broadcast(parts), [*keys, "__task"])
    return out.withColumn(name, F.col("__at") - F.col("__lo") + F.col("__before")).select(*df.columns, name)
