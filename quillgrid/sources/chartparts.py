"""Charts as their parts describe them, and their series read anew from the cells they point to."""

from __future__ import annotations

import math
import re
from xml.etree import ElementTree as ET

from quillgrid.errors import LimitError, SheetError
from quillgrid.functions.numfmt import format_value
from quillgrid.functions.refs import parse_chart_reference
from quillgrid.functions.scalars import BLANK
from quillgrid.sources.package import attribute, child, children, local
from quillgrid.sources.workbook import Sheet, Workbook

MOST_SERIES, MOST_AXES, MOST_POINTS = 1_024, 128, 100_000
#: Fixed values of the format.
KINDS = {"barChart": "bar", "lineChart": "line", "pieChart": "pie", "doughnutChart": "doughnut"}
SIDES = {"b": "bottom", "l": "left", "r": "right", "t": "top", "tr": "top-right"}


def setting(e: ET.Element | None, name: str | None = None) -> str | None:
    """The val of an element, or of its child."""
    e = e if e is None or name is None else child(e, name)
    return None if e is None else attribute(e, "val")


def number_of(text: str | None, what: str, whole: bool = False) -> float | int | None:
    if text is None:
        return None
    try:
        x = float(text)
    except ValueError:
        x = math.nan
    if not math.isfinite(x) or whole and (x < 0 or x != int(x)):
        raise SheetError("chart", f"{what} can't be {text!r}")
    return int(x) if whole else x


def truth_of(text: str | None) -> bool:
    if text not in (None, "0", "1", "false", "true"):
        raise SheetError("chart", f"{text!r} is no boolean")
    return text in ("1", "true")


def words_of(e: ET.Element | None) -> str | None:
    """The text of a title: its runs, else the first cached value."""
    if e is None:
        return None
    runs = [t.text or "" for t in e.iter() if local(t) == "t"]
    return "".join(runs) if runs else next((v.text or "" for v in e.iter() if local(v) == "v"), None)


def formula_of(e: ET.Element | None) -> str | None:
    ref = None if e is None else next((x for x in e.iter() if local(x) == "strRef"), None)
    return None if ref is None else next((f.text or "" for f in children(ref, "f")), None)


def color_of(e: ET.Element | None) -> tuple[str, str] | None:
    """A solid fill's colour: rgb with its value, or scheme with its slot."""
    fill = None if e is None else child(e, "solidFill")
    for c in fill if fill is not None else ():
        if local(c) == "srgbClr":
            if not re.fullmatch("[0-9A-Fa-f]{6}", attribute(c, "val", "")):
                raise SheetError("chart", "a colour has six hexadecimal digits")
            return "rgb", "#" + attribute(c, "val").upper()
        if local(c) == "schemeClr":
            return "scheme", attribute(c, "val")
    return None


def sequence_of(e: ET.Element | None) -> dict | None:
    """Kind, formula, number format and cached points of a series' data."""
    source = next((c for name in ("numRef", "strRef", "numLit", "strLit") for c in children(e, name)), None) if e is not None else None
    if source is None:
        return None
    kind = "number" if local(source).startswith("num") else "string"
    cache = child(source, f"{local(source)[:3]}Cache")
    cache = source if cache is None else cache
    found, declared = children(cache, "pt"), number_of(setting(cache, "ptCount"), "a count of points", True)
    if max(len(found), declared or 0) > MOST_POINTS:
        raise LimitError("too many cached points")
    points = {}
    for p in found:
        at, v = number_of(attribute(p, "idx", ""), "a point's index", True), child(p, "v")
        if at in points or declared is not None and at >= declared or v is None:
            raise SheetError("chart", f"point {at} is repeated, outside the count or empty")
        points[at] = number_of(v.text or "", "a number") if kind == "number" else v.text or ""
    code = child(cache, "formatCode")
    return {"kind": kind, "formula": next((f.text or "" for f in children(source, "f")), None), "format": None if code is None or kind == "string" else code.text, "points": dict(sorted(points.items()))}


def series_of(s: ET.Element) -> dict:
    title, shape = child(s, "tx"), child(s, "spPr")
    literal = None if title is None else child(title, "v")
    cached = next(iter((sequence_of(title) or {"points": {}})["points"].values()), None) if title is not None else None
    values = child(s, "val")
    return {
        "index": number_of(setting(s, "idx") or "", "a series' index", True),
        "order": number_of(setting(s, "order") or "", "a series' order", True),
        "title": cached if literal is None else literal.text or "",
        "title_formula": formula_of(title),
        "categories": sequence_of(child(s, "cat")),
        "values": sequence_of(child(s, "yVal") if values is None else values),
        "fill": color_of(shape),
        "line": color_of(None if shape is None else child(shape, "ln")),
    }


def axis_of(a: ET.Element) -> dict:
    scaling = child(a, "scaling")
    return {
        "id": number_of(setting(a, "axId") or "", "an axis' id", True),
        "kind": "category" if local(a) == "catAx" else "value",
        "position": SIDES.get(setting(a, "axPos") or "l", "left"),
        "title": words_of(child(a, "title")),
        "gridlines": child(a, "majorGridlines") is not None,
        "min": number_of(setting(scaling, "min"), "an axis' end"),
        "max": number_of(setting(scaling, "max"), "an axis' end"),
        "deleted": truth_of(setting(a, "delete")),
    }


def read_chart(root: ET.Element) -> dict:
    """A chart of one kind with its series, axes and legend. Other kinds, mixes, stacks and pies of several series are `unsupported`, with the reason."""
    chart = children(root, "chart")
    area = children(chart[0], "plotArea") if len(chart) == 1 else []
    if local(root) != "chartSpace" or len(area) != 1:
        raise SheetError("chart", "a chart space has one chart with one plot area")
    title, legend = child(chart[0], "title"), child(chart[0], "legend")
    out = {
        "title": words_of(title),
        "title_formula": formula_of(title),
        "legend": None if legend is None else {"position": SIDES.get(setting(legend, "legendPos") or "r", "right"), "overlay": truth_of(setting(legend, "overlay"))},
    }
    plots = [e for e in area[0] if local(e).endswith("Chart")]
    refuse = lambda reason: out | {"kind": "unsupported", "reason": reason, "series": [], "axes": []}
    if len(plots) != 1:
        return refuse("several kinds in one chart" if plots else "no kind of chart")
    plot, kind = plots[0], KINDS.get(local(plots[0]))
    if kind is None:
        return refuse(local(plot))
    if kind == "bar" and setting(plot, "barDir") != "bar":
        kind = "column"
    found, axes = children(plot, "ser"), [a for a in area[0] if local(a) in ("catAx", "valAx")]
    if len(found) > MOST_SERIES or len(axes) > MOST_AXES:
        raise LimitError("too many series or axes")
    grouping = setting(plot, "grouping") or "standard"
    if grouping in ("stacked", "percentStacked"):
        return refuse(grouping)
    if kind in ("pie", "doughnut") and len(found) > 1:
        return refuse("several series in a pie")
    hole = number_of(setting(plot, "holeSize") or "50", "the size of a hole") if kind == "doughnut" else None
    if hole is not None and not 0 <= hole <= 100:
        raise SheetError("chart", "the size of a hole is a percentage")
    return out | {"kind": kind, "grouping": "clustered" if grouping == "clustered" else "standard", "hole": hole, "series": [series_of(s) for s in found], "axes": [axis_of(a) for a in axes]}


class LiveCells:
    """Cells of a workbook after calculation, each sheet calculated when it is first asked for."""

    def __init__(self, book: Workbook):
        self.book, self.known = book, {}

    def value(self, sheet: Sheet, row: int, col: int):
        if sheet.id not in self.known:
            self.known[sheet.id] = self.book.calculate(sheet.id).values
        cell = self.book.worksheet(sheet).cell((row, col))
        return self.known[sheet.id].get((sheet.id, row, col)) or (BLANK if cell is None else cell.value)

    def text(self, sheet: Sheet, row: int, col: int) -> str:
        cell = self.book.worksheet(sheet).cell((row, col))
        return format_value(self.value(sheet, row, col), self.book.styles.format_code(cell.style if cell else 0), date1904=self.book.date1904)

    def box(self, formula: str | None):
        """Sheet and box that a chart's formula names; None where it is no such reference or the sheet isn't there."""
        found = parse_chart_reference(formula) if formula else None
        sheet = self.book.names.get(found[0].lower()) if found else None
        return None if sheet is None else (sheet, found[1])

    def title(self, formula: str | None, cached: str | None) -> str | None:
        at = self.box(formula)
        return cached if at is None else self.text(at[0], *at[1].first) or cached

    def sequence(self, s: dict | None) -> dict | None:
        at = self.box(s["formula"]) if s else None
        if at is None:
            return s
        (sheet, box), points = at, {}
        cells = ((row, col) for row in range(box.first.row, box.last.row + 1) for col in range(box.first.col, box.last.col + 1))
        for i, (row, col) in enumerate(cells):
            v = self.value(sheet, row, col)
            if s["kind"] == "string":
                points[i] = self.text(sheet, row, col)
            elif v.tag in ("number", "boolean"):
                points[i] = float(v.value)
        return s | {"points": points}


def refreshed(book: Workbook, charts: list[dict]) -> list[dict]:
    """Charts with the titles and points that the workbook's cells have now; what points elsewhere keeps its cache."""
    cells = LiveCells(book)
    fresh = lambda s: s | {"title": cells.title(s["title_formula"], s["title"]), "categories": cells.sequence(s["categories"]), "values": cells.sequence(s["values"])}
    return [c if c["kind"] == "unsupported" else c | {"title": cells.title(c["title_formula"], c["title"]), "series": [fresh(s) for s in c["series"]]} for c in charts]


def charts_of(book: Workbook, sheet: Sheet) -> list[dict]:
    """The charts of a sheet's drawings, with live data."""
    from quillgrid.sources.package import xml

    found = [part for _, drawing in book.package.related(sheet.part, "drawing") for _, part in book.package.related(drawing, "chart")]
    return refreshed(book, [read_chart(xml(book.package.part(p))) for p in found])
