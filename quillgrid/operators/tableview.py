"""Table views: filters on display text, stable multi-key sorts, distinct values and visual rows, as immutable query objects."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.errors import SheetError
from quillgrid.functions import numfmt
from quillgrid.functions.refs import Box
from quillgrid.functions.scalars import text_number
from quillgrid.functions.text import matches_wildcard, natural_key
from quillgrid.functions.text import text_number as text_number_column
from quillgrid.plans.compile import Col, column


@dataclass(frozen=True)
class ValueFilter:
    column: int
    values: tuple[str, ...] = ()
    include_blank: bool = False


@dataclass(frozen=True)
class Condition:
    operator: str  # equal, notEqual, lessThan, lessThanOrEqual, greaterThan, greaterThanOrEqual
    value: str


@dataclass(frozen=True)
class CustomFilter:
    column: int
    conditions: tuple[Condition, ...]
    all: bool = False


@dataclass(frozen=True)
class Sort:
    column: int
    descending: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class ViewState:
    filters: tuple = ()
    sorts: tuple[Sort, ...] = ()
    warnings: tuple[str, ...] = ()

    def with_values(self, column: int, values, include_blank: bool = False) -> ViewState:
        kept = tuple(f for f in self.filters if f.column != column)
        return replace(self, filters=(*kept, ValueFilter(column, tuple(dict.fromkeys(values)), include_blank)))

    def without_filter(self, column: int) -> ViewState:
        return replace(self, filters=tuple(f for f in self.filters if f.column != column))

    def sorted_by(self, column: int | None, descending: bool = False) -> ViewState:
        return replace(self, sorts=() if column is None else (Sort(column, descending),))


def saved_state(filters: list[dict], sorts: list[dict], sort_columns: bool = False) -> ViewState:
    """View state from what a file holds; what can't be applied becomes a warning, each once."""
    warnings, kept, order = [], [], []
    for f in filters:
        if f["kind"] == "values":
            kept.append(ValueFilter(f["column"], tuple(f["values"]), f.get("blank", False)))
        elif f["kind"] == "custom":
            kept.append(CustomFilter(f["column"], tuple(Condition(*c) for c in f["conditions"]), f.get("all", False)))
        else:
            warnings.append("unsupported-filter")
    if sort_columns and sorts:
        warnings.append("unsupported-sort-orientation")
    else:
        for s in sorts:
            if s.get("method", "value") != "value":
                warnings.append("unsupported-sort-method")
            else:
                order.append(Sort(s["column"], s.get("descending", False), s.get("case", False)))
    return ViewState(tuple(kept), tuple(order), tuple(dict.fromkeys(warnings)))


def check_editable(state: ViewState) -> None:
    """Raises while a filter or sort is active: rows of the view are not rows of the sheet then."""
    if state.filters or state.sorts:
        raise SheetError("view-active", "cells can't be edited while a filter or sort is active")


ORDERED = {"lessThan": lambda a, b: a < b, "lessThanOrEqual": lambda a, b: a <= b, "greaterThan": lambda a, b: a > b, "greaterThanOrEqual": lambda a, b: a >= b}


@dataclass(frozen=True)
class TableView:
    """A table: df with a unique row number column, its columns in order, and how they are shown. calculated names columns that win over df's."""

    df: DataFrame
    row: str
    columns: tuple[str, ...]
    formats: dict = field(default_factory=dict)
    locale: str = "en-US"
    values: dict = field(default_factory=dict)

    def cell(self, i: int) -> Col:
        name = self.columns[i]
        return self.values.get(name) or column(self.df, name)

    def text(self, i: int) -> Column:
        return numfmt.display(self.cell(i), self.formats.get(self.columns[i], "General"), self.locale)

    def check(self, state: ViewState) -> None:
        for kind, used in (("filter", [f.column for f in state.filters]), ("sort", [s.column for s in state.sorts])):
            if len(set(used)) < len(used):
                raise IndexError(f"a {kind} column is used twice")
            if any(not 0 <= c < len(self.columns) for c in used):
                raise IndexError(f"a {kind} column is outside the table")

    def keeps(self, f) -> Column:
        text = self.text(f.column)
        if isinstance(f, ValueFilter):
            hit = F.collate(text, "UNICODE_CI_AI").isin(*f.values) if f.values else F.lit(False)
            return F.when(text == "", F.lit(f.include_blank)).otherwise(hit)
        parts = [self.satisfies(f.column, text, c) for c in f.conditions]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if f.all else (out | p)
        return out

    def satisfies(self, i: int, text: Column, c: Condition) -> Column:
        if c.operator in ("equal", "notEqual"):
            hit = matches_wildcard(text, c.value)
            return hit if c.operator == "equal" else ~hit
        apply = ORDERED[c.operator]
        wanted = 0.0 if not c.value.strip() else text_number(c.value)
        by_text = apply(natural_key(text), natural_key(F.lit(c.value)))
        if wanted is None:
            return by_text
        cell = self.cell(i)
        if cell.num is not None and cell.str is None and cell.bool is None and cell.err is None:
            return apply(F.coalesce(cell.num, F.lit(0.0)), F.lit(wanted))
        number = F.when(text == "", 0.0).otherwise(text_number_column(text))
        number = number if cell.num is None else F.coalesce(cell.num, number)
        return F.when(number.isNotNull(), apply(number, F.lit(wanted))).otherwise(by_text)

    def predicate(self, state: ViewState) -> Column:
        self.check(state)
        out = F.lit(True)
        for f in state.filters:
            out = out & self.keeps(f)
        return out

    def order(self, state: ViewState) -> list[Column]:
        """Sort keys: blanks last, numbers, booleans and text by the text order among different types; descending turns all of it round."""
        self.check(state)
        out = []
        for s in state.sorts:
            c = self.cell(s.column)
            fields = [c.num is not None, c.str is not None or c.err is not None, c.bool is not None]
            blank = c.tag == "blank"
            if sum(fields) == 1 and fields[0]:
                keys = [blank, c.num]
            elif sum(fields) == 1 and fields[2]:
                keys = [blank, c.bool]
            else:
                words = F.coalesce(*[x for x in (c.err, c.str, None if c.bool is None else F.when(c.bool, "true").when(~c.bool, "false"), None if c.num is None else c.text) if x is not None], F.lit(""))
                keys = [blank, natural_key(words), *([_swapped(words)] if s.case_sensitive else [])]
                if c.num is not None:  # among numbers, by value
                    keys.insert(2, c.num)
            out += [k.desc_nulls_first() if s.descending else k.asc_nulls_last() for k in keys]
        return [*out, F.col(self.row).asc()]

    def rows(self, state: ViewState) -> DataFrame:
        """The projected rows in view order."""
        return self.df.where(self.predicate(state)).orderBy(*self.order(state))

    def filtered_out(self, state: ViewState) -> DataFrame:
        """Row numbers that the filters hide, in source order."""
        return self.df.where(~self.predicate(state)).select(self.row).orderBy(self.row)

    def visual(self, state: ViewState, spread: bool = True) -> DataFrame:
        """row and slot: the k-th body slot shows the k-th projected row.

        Each task numbers its own range of the order, so tables have no limit; without spread one window numbers them all, which suits a few rows."""
        if not spread:
            return self.df.where(self.predicate(state)).select(self.row, F.row_number().over(Window.orderBy(*self.order(state))).alias("slot"))
        return self.shown(state).select(self.row, "slot")

    def shown(self, state: ViewState) -> DataFrame:
        """The projected rows with their slot, in no order of their own."""
        kept = self.df.where(self.predicate(state))
        return numbered(kept, self.order(state), "slot").withColumn("slot", F.col("slot").cast("int"))

    def distinct(self, i: int) -> DataFrame:
        """Distinct display texts, exact, with a key in whose order they are listed, and pos, their place (1, 2, ...) in it."""
        found = self.df.select(self.text(i).alias("text")).distinct().withColumn("key", natural_key(F.col("text")))
        return numbered(found, [F.col("key"), F.col("text")], "pos").select("text", "key", F.col("pos").cast("int").alias("pos"))


def body(df: DataFrame, row: str, box: Box, header_rows: int = 1, totals_rows: int = 0) -> DataFrame:
    """The rows of a table's body: those of its box but for header and totals rows. row is the column with each row's number in the sheet."""
    return df.where(F.col(row).between(box.first.row + header_rows, box.last.row - totals_rows))


def _swapped(text: Column) -> Column:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, lower + upper, upper + lower)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with 1, 2, ... in the given order. The sorted ranges are checkpointed in spark.checkpoint.dir; only a row for each task is summed up in one place."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark))
    ranges = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    task = F.shiftright("__at", 33)
    counts = ranges.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__task", before.alias("__before"))
    within = F.col("__at") - F.shiftleft(F.col("__task"), 33)
    # a row for each task that sorted a range
    return ranges.withColumn("__task", task).join(F.broadcast(starts), "__task").withColumn(name, within + F.col("__before") + 1).drop("__at", "__task", "__before")


def own_folder(spark) -> str:
    """A folder for checkpoints where the session names none: on one machine only."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='quillgrid-')}"
