"""Chart data: series binding, bounds, ticks, slices, line segments and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.plans.compile import Col


def series_points(points: DataFrame, cell: Col, index: str, numeric: bool, display: Column | None = None) -> DataFrame:
    """index and value of a series: numbers as they are, booleans as 1 and 0, all else a gap that keeps its index; text series take every display text."""
    if not numeric:
        return points.select(index, display.alias("value"))
    parts = [c for c in (cell.num, None if cell.bool is None else cell.bool.cast("int").cast("double")) if c is not None]
    value = F.coalesce(*parts, F.lit(None).cast("double"))
    return points.select(index, value.alias("value")).where(F.col("value").isNotNull())


def bounds(points: DataFrame, value: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """One row lo, hi: zero and all values, unless an axis sets them; equal ends are spread, reversed ends swapped."""
    lo = F.lit(float(least)) if least is not None else F.least(F.lit(0.0), F.coalesce(F.min(value), F.lit(0.0)))
    hi = F.lit(float(most)) if most is not None else F.greatest(F.lit(0.0), F.coalesce(F.max(value), F.lit(0.0)))
    found = points.agg(lo.alias("a"), hi.alias("b"))
    found = found.select(F.col("a"), F.when(F.col("a") == F.col("b"), F.col("a") + 1).otherwise(F.col("b")).alias("b"))
    return found.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def coordinate(value: Column, lo: Column, hi: Column, start: float, length: float, reverse: bool = False) -> Column:
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lo) / (hi - lo)))
    return F.lit(start) + (1 - share if reverse else share) * length


def nice_step(span: float, count: int) -> float:
    """1, 2, 5 or 10 times a power of ten, for about count steps."""
    if not span > 0:
        return 1.0
    rough = span / max(1, count)
    power = 10.0 ** math.floor(math.log10(rough))
    return power * next(k for k in (1, 2, 5, 10) if rough / power <= k)


def ticks(bounds_: DataFrame, count: int = 5) -> DataFrame:
    """step and the ticks within lo and hi."""
    rough = (F.col("hi") - F.col("lo")) / count
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    ratio = rough / power
    step = F.when(ratio <= 1, 1).when(ratio <= 2, 2).when(ratio <= 5, 5).otherwise(10) * power
    out = bounds_.withColumn("step", step)
    index = F.sequence(F.ceil(F.col("lo") / F.col("step")).cast("long"), F.floor(F.col("hi") / F.col("step")).cast("long"))
    return out.select("step", F.explode(index).alias("i")).select("step", (F.col("i") * F.col("step")).alias("tick"))


def pie_slices(points: DataFrame, index: str, value: str) -> DataFrame:
    """Start and end angle of each positive value, from the top round. Points of a chart are few; the running sum is one window."""
    positive = points.where(F.col(value) > 0)
    whole = positive.agg(F.sum(value).alias("__total"))
    share = 2 * math.pi / F.col("__total")
    run = F.sum(value).over(Window.orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    out = positive.crossJoin(F.broadcast(whole)).withColumn("__run", run)
    return out.select(index, value, (F.lit(-math.pi / 2) + (F.col("__run") - F.col(value)) * share).alias("start_angle"), (F.lit(-math.pi / 2) + F.col("__run") * share).alias("end_angle"))


def line_segments(points: DataFrame, series: str, index: str) -> DataFrame:
    """A segment number for each point: a new one begins after a gap."""
    w = Window.partitionBy(series).orderBy(index)
    new = F.coalesce(F.col(index) != F.lag(index).over(w) + 1, F.lit(True)).cast("int")
    return points.withColumn("__new", new).withColumn("segment", F.sum("__new").over(w)).drop("__new")


def categories(points: DataFrame, index: str, label: str) -> Column:
    return F.coalesce(F.col(label), (F.col(index) + 1).cast("string"))


def plot_rectangle(width: float, height: float, title: bool, legend: str | None) -> tuple[float, float, float, float]:
    """x, y, width and height of the plot inside a chart: margins for axes, title and legend."""
    left, top, right, bottom = 52.0, 36.0 if title else 16.0, 16.0, 38.0
    right += 100.0 if legend in ("right", "r") else 0.0
    left += 100.0 if legend in ("left", "l") else 0.0
    top += 24.0 if legend in ("top", "t") else 0.0
    bottom += 24.0 if legend in ("bottom", "b") else 0.0
    return left, top, max(1.0, width - left - right), max(1.0, height - top - bottom)


def arc_path(cx: float, cy: float, r: float, start: float, end: float, inner: float = 0.0) -> str:
    """An SVG path of a pie slice, or of a ring's slice with an inner radius."""
    at = lambda a, rr: f"{cx + rr * math.cos(a):.3f} {cy + rr * math.sin(a):.3f}"
    if end - start >= 2 * math.pi - 1e-9:
        middle = start + math.pi
        ring = lambda rr, sweep: f"M {at(start, rr)} A {rr:g} {rr:g} 0 1 {sweep} {at(middle, rr)} A {rr:g} {rr:g} 0 1 {sweep} {at(start, rr)} Z"
        return ring(r, 1) + (" " + ring(inner, 0) if inner else "")
    large = int(end - start > math.pi)
    if inner:
        return f"M {at(start, r)} A {r:g} {r:g} 0 {large} 1 {at(end, r)} L {at(end, inner)} A {inner:g} {inner:g} 0 {large} 0 {at(start, inner)} Z"
    return f"M {cx:.3f} {cy:.3f} L {at(start, r)} A {r:g} {r:g} 0 {large} 1 {at(end, r)} Z"
