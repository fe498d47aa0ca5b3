"""The implicit joins of a workbook: cell lookups, range scans, containment, and the style cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.refs import Address, Box


def cell(df: DataFrame, key: str, first_row: int, at: Address) -> DataFrame:
    """The row of df that the address lies in, where key numbers the rows and key 0 lies in first_row; a filter on key that scans can push down."""
    return df.where(F.col(key) == at.row - first_row)


def cross_sheet(cells: DataFrame, sheets: dict[str, DataFrame], sheet: str, key: str, target_key: str, value: str, default: Column) -> DataFrame:
    """value of the row with an equal key in the sheet that each cell names; a missing cell gives default, a sheet that isn't there #REF!."""
    targets = [df.select(F.lit(name).alias("__sheet"), F.col(target_key).alias("__key"), F.col(value).cast("string").alias("__value")) for name, df in sheets.items()]
    found = reduce(DataFrame.union, targets)
    name = F.lower(F.col(sheet))
    met = cells.join(found, (name == F.lower(F.col("__sheet"))) & (F.col(key) == F.col("__key")), "left")
    known = name.isin(*[n.lower() for n in sheets])
    return met.withColumn("value", F.when(known, F.coalesce("__value", default)).otherwise("#REF!")).drop("__sheet", "__key", "__value")


def used_range(cells: DataFrame) -> DataFrame:
    """One row: the smallest box (row1, col1, row2, col2) that holds all cells (row, col); nulls without cells."""
    return cells.agg(F.min("row").alias("row1"), F.min("col").alias("col1"), F.max("row").alias("row2"), F.max("col").alias("col2"))


def shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Cells whose sst index is replaced by its text; a missing index raises when it is read."""
    out = cells.join(strings, "sst_index", "left")
    missing = F.raise_error(F.concat(F.lit("no shared string "), F.col("sst_index").cast("string")))
    return out.withColumn("text", F.coalesce("text", missing))


def range_scan(spark, box: Box, cells: DataFrame) -> DataFrame:
    """All cells of a rectangle in row-major order, with what cells(row, col, ...) has of them. The grid is generated on the executors."""
    rows = spark.range(box.first.row, box.last.row + 1).select(F.col("id").cast("int").alias("row"))
    grid = rows.select("row", F.explode(F.sequence(F.lit(box.first.col), F.lit(box.last.col))).alias("col"))
    inside = cells.where(F.col("row").between(box.first.row, box.last.row) & F.col("col").between(box.first.col, box.last.col))
    index = ((F.col("row") - box.first.row).cast("long") * (box.last.col - box.first.col + 1) + F.col("col") - box.first.col).alias("index")
    return grid.join(inside, ["row", "col"], "left").withColumn("index", index)


def contains(boxes: DataFrame, row: Column, col: Column) -> Column:
    return (row >= boxes["row1"]) & (row <= boxes["row2"]) & (col >= boxes["col1"]) & (col <= boxes["col2"])


def first_containing(cells: DataFrame, boxes: DataFrame, order: str, value: str, band: int = 256) -> DataFrame:
    """Each cell (row, col) with value of the first box (row1, col1, row2, col2) that holds it, in the order given.

    Boxes are cut into bands of rows, so that the join has an equality and a cell meets only boxes of its own band."""
    cut = boxes.withColumn("__band", F.explode(F.sequence(F.floor((F.col("row1") - 1) / band), F.floor((F.col("row2") - 1) / band))))
    banded = cells.withColumn("__band", F.floor((F.col("row") - 1) / band))
    hit = (banded["__band"] == cut["__band"]) & contains(cut, banded["row"], banded["col"])
    found = banded.join(cut.select("__band", "row1", "col1", "row2", "col2", F.col(order).alias("__order"), F.col(value).alias("__value")), hit)
    best = found.groupBy(banded["row"].alias("row"), banded["col"].alias("col")).agg(F.min_by("__value", "__order").alias(value))
    return cells.join(best, ["row", "col"], "left")


def style_cascade(cells: DataFrame, rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The style of each cell: its own, else that of a row with a custom format, else of the last column span that has one, else 0."""
    custom = rows.where("custom_format").select("row", F.col("style_index").alias("__row_style"))
    columns = spans.where("style_index IS NOT NULL").select(F.explode(F.sequence("min", "max")).alias("col"), "ord", F.col("style_index").alias("__s"))
    last = columns.groupBy("col").agg(F.max_by("__s", "ord").alias("__col_style"))
    out = cells.join(custom, "row", "left").join(last, "col", "left")
    return out.withColumn("style", F.coalesce("style_index", "__row_style", "__col_style", F.lit(0))).drop("__row_style", "__col_style")


def dependency_edges(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """One edge for each cell that a formula's references reach, each address once. boxes: formula_id, row1, col1, row2, col2."""
    rows = boxes.select("formula_id", F.explode(F.sequence("row1", "row2")).alias("row"), "col1", "col2")
    return rows.select("formula_id", "row", F.explode(F.sequence("col1", "col2")).alias("col")).distinct()


def overlay(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cells (row, col, value) after edits (row, col, value, seq): the last edit of a cell wins; null clears, and is nothing for a cell that isn't there."""
    last = edits.groupBy("row", "col").agg(F.max_by(F.struct("value"), "seq").alias("edit"))
    both = cells.withColumn("__there", F.lit(True)).join(last, ["row", "col"], "full")
    kept = both.where(F.col("__there").isNotNull() | F.col("edit.value").isNotNull())
    return kept.select("row", "col", F.when(F.col("edit").isNull(), F.col("value")).otherwise(F.col("edit.value")).alias("value"))
