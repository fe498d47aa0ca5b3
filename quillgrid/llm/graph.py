"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of two ids up to which a label table is broadcast (8 MB); larger ones are joined by shuffles.
BROADCAST_LABELS = 500_000


def small(table: DataFrame, rows: int) -> DataFrame:
    """table, with a broadcast hint if it has few enough rows."""
    return F.broadcast(table) if rows <= BROADCAST_LABELS else table


def components(links: DataFrame, work, known: DataFrame | None = None) -> DataFrame:
    """links has columns a and b; the result has a row (id, component) for each of their ids, component being the smallest id reachable.

    Every round maps each id to the least of itself and its neighbours, and that once more, and then puts the images into the links and drops
    those that have become loops or equal; so the links shrink from round to round, a star to nothing in two. The smallest id of a
    component always keeps itself, and is what is left. Tables are written to the shared folder each round; no ids come to the driver.

    known: what earlier links gave, with the same columns; only their components are joined by the new links then."""
    if known is not None:
        size = known.count()
        on = lambda c: small(known.select(F.col("id").alias(c), F.col("component").alias(f"to_{c}")), size)
        links = links.join(on("a"), "a", "left").join(on("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
    edges = work.save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = work.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("low")))
        n = low.count()
        lower = low.join(small(low.select(F.col("id").alias("low"), F.col("low").alias("jump")), n), "low").select("id", F.col("jump").alias("image"))
        lower = work.save(lower)
        if labels is None:
            labels = lower.withColumnRenamed("image", "component")
        else:
            images = small(lower.select(F.col("id").alias("component"), "image"), n)
            labels = work.save(labels.join(images, "component", "left").select("id", F.coalesce("image", "component").alias("component")))
        x = small(lower.select(F.col("id").alias("a"), F.col("image").alias("x")), n)
        y = small(lower.select(F.col("id").alias("b"), F.col("image").alias("y")), n)
        moved = edges.join(x, "a").join(y, "b").where("x <> y")
        new = work.save(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        work.drop(edges, low)
        edges = new
    if known is None:
        return labels
    images = small(labels.select(F.col("id").alias("component"), F.col("component").alias("image")), labels.count())
    old = known.join(images, "component", "left").select("id", F.coalesce("image", "component").alias("component"))
    return work.save(old.union(labels.join(known.select("id"), "id", "left_anti").select("id", "component")))
