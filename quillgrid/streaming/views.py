"""Table views and formulas over streams: filters, fill-down formulas and display text keep no state, so they run on a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.tableview import TableView, ViewState
from quillgrid.plans.compile import fill_down


def filtered_stream(stream: DataFrame, row: str, columns: list[str], state: ViewState) -> DataFrame:
    """Rows of a stream that the view's filters keep. Sorts need all rows and are refused."""
    if state.sorts:
        raise ValueError("a stream has no end, so a view over it cannot be sorted")
    view = TableView(stream, row, tuple(columns))
    return stream.where(view.predicate(state))


def formula_stream(stream: DataFrame, name: str, formula: str, columns: list[str]) -> DataFrame:
    return stream.withColumn(name, fill_down(stream, formula, columns).struct())


def windowed_totals(stream: DataFrame, time: str, value: str, window: str, late: str) -> DataFrame:
    """An extension: totals for each window of time, rows later than late left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
