"""Axis geometry, sizes in pixels, viewports, selections, text overflow and colours."""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.refs import MAX_ROWS
from quillgrid.functions.text import text_number as text_number_column

EMU_PER_PIXEL = 9525


class SparseAxis:
    """Sizes of count items, all default but for overrides; starts by prefix sums."""

    def __init__(self, count: int, default: float, overrides: dict[int, float]):
        self.count, self.default = count, default
        self.at = sorted(i for i in overrides if 1 <= i <= count)
        self.sizes = dict(overrides)
        self.before = [0.0]
        for i in self.at:
            self.before.append(self.before[-1] + overrides[i] - default)

    @property
    def total(self) -> float:
        return self.count * self.default + self.before[-1]

    def size(self, i: int) -> float:
        return self.sizes.get(i, self.default)

    def start(self, i: int) -> float:
        return (i - 1) * self.default + self.before[bisect_right(self.at, i - 1)]

    def index_at(self, offset: float) -> int:
        """The item that covers an offset; items without size are never hit; past the end, the last one."""
        if offset >= self.total:
            return self.count
        lo, hi = 1, self.count
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.start(mid) <= offset:
                lo = mid
            else:
                hi = mid - 1
        while lo < self.count and self.size(lo) == 0:
            lo += 1
        return lo


#: Items of an axis whose sizes are summed up together.
AXIS_BLOCK = 4096
#: Blocks that the rows of a sheet make.
MOST_BLOCKS = -(-MAX_ROWS // AXIS_BLOCK)


def axis_starts(items: DataFrame, index: str, size: str, default: float) -> DataFrame:
    """start of every item (1, 2, ...): default sizes, plus what the overrides before it add. size is null where there is no override.

    Items are summed in order within blocks; only a row for each block is summed in one place."""
    block = F.floor((F.col(index) - 1) / AXIS_BLOCK)
    delta = F.coalesce(F.col(size) - default, F.lit(0.0))
    sums = items.where(F.col(size).isNotNull()).groupBy(block.alias("__block")).agg(F.sum(delta).alias("__sum"))
    upto = F.sum("__sum").over(Window.orderBy("__block"))
    after = F.lead("__block", 1, 1 << 40).over(Window.orderBy("__block"))
    # blocks without overrides have what the last one before them has
    sums = sums.select("__block", upto.alias("__upto"), after.alias("__next"))
    sums = sums.select("__upto", F.explode(F.sequence(F.col("__block") + 1, F.least("__next", F.lit(MOST_BLOCKS)))).alias("__block"))
    within = F.sum(delta).over(Window.partitionBy("__block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1))
    out = items.withColumn("__block", block).withColumn("__within", F.coalesce(within, F.lit(0.0))).join(sums, "__block", "left")
    return out.withColumn("start", (F.col(index) - 1) * F.lit(float(default)) + F.coalesce("__upto", F.lit(0.0)) + F.col("__within")).drop("__block", "__within", "__upto")


def axis_total(items: DataFrame, size: str, default: float) -> DataFrame:
    return items.agg((F.count("*") * F.lit(float(default)) + F.coalesce(F.sum(F.col(size) - default), F.lit(0.0))).alias("total"))


def axis_index_at(offsets: DataFrame, starts: DataFrame, offset: str, index: str, size: Column, step: float = 1280.0) -> DataFrame:
    """index: the item that covers the offset; items without size are never hit; past the end, the last item. starts: the items of an axis with start.

    Items and offsets meet in stretches of step pixels, so that the join has an equality and an offset meets only the items of its own stretch."""
    some = starts.where(size > 0).select(F.col(index).alias("index"), F.col("start").alias("__s"), (F.col("start") + size).alias("__e"))
    some = some.withColumn("__at", F.explode(F.sequence(F.floor(F.col("__s") / step), F.ceil(F.col("__e") / step) - 1)))
    hit = (F.col("__at") == F.floor(F.col(offset) / step)) & (F.col(offset) >= F.col("__s")) & (F.col(offset) < F.col("__e"))
    end = starts.agg(F.struct(F.max(F.col("start") + size).alias("total"), F.max(index).alias("last")).alias("v")).scalar()
    found = offsets.join(some, hit, "left").drop("__s", "__e", "__at")
    return found.withColumn("index", F.when(F.col(offset) >= end["total"], end["last"]).otherwise(F.col("index")))


#: Starts up to this many are broadcast to anchors (two numbers each).
BROADCAST_STARTS = 200_000


def anchor_bounds(anchors: DataFrame, starts: DataFrame, item: str, emu: str, index: str = "i") -> DataFrame:
    """anchors with x, in pixels: the start of the item that holds the anchor, and its offset (in EMU) into it."""
    known = starts.select(F.col(index).alias(item), F.col("start").alias("__start"))
    few = known.limit(BROADCAST_STARTS + 1).count() <= BROADCAST_STARTS
    return anchors.join(F.broadcast(known) if few else known, item).withColumn("x", F.col("__start") + emu_px(F.col(emu))).drop("__start")


def column_width_px(width: Column, digit: int = 7) -> Column:
    return F.floor((256 * width + math.floor(128 / digit)) / 256 * digit).cast("long")


def row_height_px(points: Column) -> Column:
    return F.floor(points * 4 / 3 + 0.5).cast("long")


def width_px(width: float, digit: int = 7) -> int:
    return math.floor((256 * width + math.floor(128 / digit)) / 256 * digit)


def height_px(points: float) -> int:
    return math.floor(points * 4 / 3 + 0.5)


def emu_px(emu: Column) -> Column:
    return emu / EMU_PER_PIXEL


def row_auto_height(cells: DataFrame, row: str, size: Column, leading: Column, text: Column, wrap: Column) -> DataFrame:
    """The height of each row: the tallest cell, a line for each hard break where text wraps."""
    lines = F.when(wrap, F.size(F.split(text, "\n"))).otherwise(1)
    return cells.groupBy(row).agg(F.max((size + leading) * lines).alias("height"))


def viewport(items: DataFrame, start: str, size: str, scroll: float, extent: float, overscan: float = 0.0) -> DataFrame:
    """Items that show between scroll and scroll + extent, and overscan around; those without size don't."""
    return items.where((F.col(size) > 0) & (F.col(start) + F.col(size) > scroll - overscan) & (F.col(start) < scroll + extent + overscan))


def text_overflow(cells: DataFrame, row: str, col: str, width: str, occupied: Column) -> DataFrame:
    """How wide each occupied cell's text may show: its own width and that of empty cells to its right, up to the next occupied one."""
    w = Window.partitionBy(row).orderBy(col)
    island = cells.withColumn("__occ", occupied).withColumn("__island", F.sum(F.col("__occ").cast("int")).over(w))
    spill = F.sum(width).over(Window.partitionBy(row, "__island"))
    return island.withColumn("spill", spill).where("__occ").drop("__occ", "__island")


def alignment(tag: Column) -> Column:
    return F.when(tag.isin("number", "date"), "right").when(tag.isin("boolean", "error"), "center").otherwise("left")


@dataclass(frozen=True)
class Selection:
    """Anchor and focus of a grid selection."""

    row: int
    col: int
    to_row: int
    to_col: int

    @property
    def box(self) -> tuple[int, int, int, int]:
        return min(self.row, self.to_row), min(self.col, self.to_col), max(self.row, self.to_row), max(self.col, self.to_col)

    def move(self, rows: int, cols: int, most_row: int, most_col: int, extend: bool = False) -> Selection:
        r = min(max(1, self.to_row + rows), most_row)
        c = min(max(1, self.to_col + cols), most_col)
        return Selection(self.row, self.col, r, c) if extend else Selection(r, c, r, c)


@dataclass(frozen=True)
class Pane:
    """Frozen rows and columns of a grid with headers, and how far its body is scrolled."""

    rows: SparseAxis
    columns: SparseAxis
    frozen_rows: int = 0
    frozen_columns: int = 0
    top: float = 0.0
    left: float = 0.0

    def translation(self, row: int, col: int) -> tuple[float, float]:
        """How a cell moves against the scrolled body so that frozen ones stand still: x, y."""
        return self.left if col <= self.frozen_columns else 0.0, self.top if row <= self.frozen_rows else 0.0

    def layer(self, row: int, col: int) -> int:
        """Frozen cells lie above the others."""
        return 2 if row <= self.frozen_rows or col <= self.frozen_columns else 1

    def region(self, anchor: dict) -> str:
        """Which part of the grid a drawing belongs to; markers count from 0."""
        if anchor["kind"] == "absoluteAnchor":
            return "body"
        first = anchor["from"]
        return "frozen-row" if first["row"] < self.frozen_rows else "frozen-column" if first["col"] < self.frozen_columns else "body"

    def place(self, anchor: dict, bounds: tuple[float, float, float, float], view: tuple[float, float], headers: tuple[float, float]) -> dict:
        """Left and top of a drawing (x, y, width, height) in the container that owns its region, and whether any of it shows in a view of this width and height."""
        (x, y, width, height), (head_x, head_y), region = bounds, headers, self.region(anchor)
        stop_x, stop_y = frozen_extent(self.columns, self.frozen_columns), frozen_extent(self.rows, self.frozen_rows)
        # along each axis: place in the container, place on the screen, and the stretch of the screen that the region has
        if region == "body":
            across = (head_x + x, head_x + x - self.left, head_x + stop_x, view[0])
            down = (head_y + y, head_y + y - self.top, head_y + stop_y, view[1])
        elif region == "frozen-row":
            at = x if anchor["from"]["col"] < self.frozen_columns else x - self.left
            across, down = (at, head_x + at, head_x, view[0]), (y, head_y + y, head_y, head_y + stop_y)
        else:
            at = y - self.top - stop_y
            across, down = (x, head_x + x, head_x, head_x + stop_x), (at, head_y + stop_y + at, head_y + stop_y, view[1])
        shows = all(low < at + size and at < high for (_, at, low, high), size in ((across, width), (down, height)))
        return {"region": region, "left": across[0], "top": down[0], "visible": shows}

    def items(self, axis: SparseAxis, frozen: int, seen: list[int]) -> list[int]:
        """The items that are drawn: those in view, and all frozen ones that have a size."""
        return sorted({*seen, *(i for i in range(1, min(frozen, axis.count) + 1) if axis.size(i) > 0)})

    def layout(self, rows: list[int], cols: list[int], merges: list) -> dict:
        """Rows and columns to draw for those in view, and the merged boxes that reach into them with left, top, width and height."""
        rows, cols = self.items(self.rows, self.frozen_rows, rows), self.items(self.columns, self.frozen_columns, cols)
        inside = lambda items, a, b: bisect_right(items, b) > bisect_right(items, a - 1)
        span = lambda axis, a, b: axis.start(b) + axis.size(b) - axis.start(a)
        drawn = [
            {"box": m, "left": self.columns.start(m.first.col), "top": self.rows.start(m.first.row), "width": span(self.columns, m.first.col, m.last.col), "height": span(self.rows, m.first.row, m.last.row)}
            for m in merges
            if inside(rows, m.first.row, m.last.row) and inside(cols, m.first.col, m.last.col)
        ]
        return {"rows": rows, "columns": cols, "merges": drawn}


def frozen_extent(axis: SparseAxis, frozen: int) -> float:
    """Pixels that the first items of an axis take."""
    if frozen < 0:
        raise ValueError("the number of frozen items is negative")
    last = min(frozen, axis.count)
    return axis.start(last) + axis.size(last) if last else 0.0


def tint(rgb: str, amount: float) -> str:
    """A colour made lighter (amount > 0) or darker, by its lightness."""
    r, g, b = (int(rgb[i : i + 2], 16) / 255 for i in (0, 2, 4))
    hi, lo = max(r, g, b), min(r, g, b)
    light, spread = (hi + lo) / 2, hi - lo
    hue = sat = 0.0
    if spread:
        sat = spread / (1 - abs(2 * light - 1))
        hue = ((g - b) / spread) % 6 if hi == r else (b - r) / spread + 2 if hi == g else (r - g) / spread + 4
    light = light * (1 + amount) if amount < 0 else light * (1 - amount) + amount
    c = (1 - abs(2 * light - 1)) * sat
    x, m = c * (1 - abs(hue % 2 - 1)), light - c / 2
    parts = [(c, x, 0), (x, c, 0), (0, c, x), (0, x, c), (x, 0, c), (c, 0, x)][int(hue) % 6]
    return "".join(f"{math.floor((p + m) * 255 + 0.5):02X}" for p in parts)


def tint_column(r: Column, g: Column, b: Column, amount: Column) -> Column:
    """As tint, on columns of 0 to 255: RRGGBB."""
    r, g, b = r / 255, g / 255, b / 255
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    light, spread = (hi + lo) / 2, hi - lo
    sat = F.when(spread == 0, 0.0).otherwise(F.try_divide(spread, 1 - F.abs(2 * light - 1)))
    hue = F.when(spread == 0, 0.0).when(hi == r, F.pmod(F.try_divide(g - b, spread), F.lit(6.0))).when(hi == g, F.try_divide(b - r, spread) + 2).otherwise(F.try_divide(r - g, spread) + 4)
    new = F.when(amount < 0, light * (1 + amount)).otherwise(light * (1 - amount) + amount)
    c = (1 - F.abs(2 * new - 1)) * sat
    x, m = c * (1 - F.abs(F.pmod(hue, F.lit(2.0)) - 1)), new - c / 2
    k = F.floor(hue)
    zero = F.lit(0.0)
    red = F.when(k.isin(0, 5), c).when(k.isin(1, 4), x).otherwise(zero)
    green = F.when(k.isin(1, 2), c).when(k.isin(0, 3), x).otherwise(zero)
    blue = F.when(k.isin(3, 4), c).when(k.isin(2, 5), x).otherwise(zero)
    two = lambda p: F.lpad(F.hex(F.floor((p + m) * 255 + 0.5).cast("long")), 2, "0")
    return F.concat(two(red), two(green), two(blue))


def edit_coercion(draft: str, tag: str) -> object:
    """The value a typed text stands for, given what the cell holds."""
    from quillgrid.functions.scalars import text_number

    if draft == "":
        return None
    if tag == "boolean" and draft.strip().upper() in ("TRUE", "FALSE"):
        return draft.strip().upper() == "TRUE"
    if tag == "string":
        return draft
    x = text_number(draft)
    return draft if x is None else x


def formula_bar(draft: str, tag: str) -> tuple[str, object]:
    """What a text in the formula bar sets: a formula after an equals sign, else the value it stands for. Only the formula bar knows formulas."""
    return ("formula", draft[1:]) if draft.startswith("=") else ("value", edit_coercion(draft, tag))


def edit_tag(draft: Column, tag: Column) -> Column:
    """The type of the value that a typed text stands for, given the type of what the cell holds; null clears the cell. As edit_coercion, on columns."""
    boolean = (tag == "boolean") & F.upper(F.btrim(draft)).isin("TRUE", "FALSE")
    return F.when(draft == "", None).when(boolean, "boolean").when(tag == "string", "string").when(text_number_column(draft).isNotNull(), "number").otherwise("string")
