"""Spreadsheet parts: workbook, worksheets, shared strings, styles, tables, links, drawings, charts and properties."""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from quillgrid.errors import SheetError
from quillgrid.functions import refs
from quillgrid.functions.numfmt import BUILT_IN
from quillgrid.functions.scalars import BLANK, Value, text_number
from quillgrid.operators.geometry import SparseAxis, height_px, tint, width_px
from quillgrid.plans.interpret import Cell
from quillgrid.sources.package import Package, attribute, child, children, local, xml

TRUE = ("1", "true")
#: Fixed values of the format.
TABLE = "application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml"
STRICT = "http://purl.oclc.org/ooxml"


def flag(e: ET.Element, name: str, default: bool = False) -> bool:
    v = attribute(e, name)
    return default if v is None else v.lower() in TRUE


def integer(e: ET.Element, name: str, default=None):
    v = attribute(e, name)
    return default if v is None else int(v)


def real(e: ET.Element, name: str, default=None):
    v = attribute(e, name)
    return default if v is None else float(v)


def rich_text(e: ET.Element) -> str:
    """The text of t, or of all r/t; phonetic runs are no text."""
    return "".join((c.text or "") if local(c) == "t" else "".join(t.text or "" for t in children(c, "t")) for c in e if local(c) in ("t", "r"))


@dataclass
class Sheet:
    id: int
    name: str
    part: str
    state: str = "visible"


@dataclass
class SheetCell:
    row: int
    col: int
    value: Value
    formula: str | None = None
    style: int = 0
    lexical: str | None = None
    storage: str | None = None
    locked: bool = False  # part of a shared or array formula

    @property
    def ref(self) -> str:
        return refs.format_cell(refs.Address(self.row, self.col))


@dataclass
class Worksheet:
    cells: dict = field(default_factory=dict)
    rows: dict = field(default_factory=dict)
    columns: list = field(default_factory=list)
    merges: list = field(default_factory=list)
    panes: list = field(default_factory=list)
    links: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    anchors: list = field(default_factory=list)
    dimension: str | None = None
    default_height: float = 15.0
    default_width: float = 8.43
    tab_color: str | None = None
    tab: dict | None = None

    def row_axis(self, count: int = refs.MAX_ROWS) -> SparseAxis:
        """Row heights in pixels; hidden rows have none."""
        own = {r: 0.0 if x["hidden"] else float(height_px(x["height"] if x["height"] is not None else self.default_height)) for r, x in self.rows.items() if x["hidden"] or x["height"] is not None}
        return SparseAxis(count, float(height_px(self.default_height)), own)

    def column_axis(self, count: int = refs.MAX_COLUMNS) -> SparseAxis:
        """Column widths in pixels; hidden columns have none."""
        own = {}
        for c in self.columns:
            px = 0.0 if c["hidden"] else float(width_px(c["width"] if c["width"] is not None else self.default_width))
            own |= dict.fromkeys(range(c["min"], min(c["max"], count) + 1), px)
        return SparseAxis(count, float(width_px(self.default_width)), own)

    def cell(self, ref) -> SheetCell | None:
        return self.cells.get(tuple(refs.parse_cell(ref) if isinstance(ref, str) else ref))


class Workbook:
    def __init__(self, data: bytes):
        self.package = Package(data)
        if self.package.family != "spreadsheet":
            raise SheetError("not-a-spreadsheet", "the main part is no workbook")
        main = self.package.main_part
        root = xml(self.package.part(main))
        self.strict = root.tag.startswith("{" + STRICT)
        properties = child(root, "workbookPr")
        self.date1904 = properties is not None and flag(properties, "date1904")
        targets = {r.id: part for r, part in self.package.related(main, "worksheet")}
        self.sheets: list[Sheet] = []
        for e in children(child(root, "sheets"), "sheet") if child(root, "sheets") is not None else []:
            rid = next((v for k, v in e.attrib.items() if k.endswith("}id")), None)
            if rid not in targets:
                raise SheetError("sheet-part", f"{attribute(e, 'name')!r} has no part")
            else:
                self.sheets.append(Sheet(int(attribute(e, "sheetId")), attribute(e, "name"), targets[rid], attribute(e, "state", "visible")))
        for values, what in (([s.id for s in self.sheets], "sheetId"), ([s.name.lower() for s in self.sheets], "name")):
            if len(set(values)) < len(values):
                raise SheetError("sheet-duplicate", f"two sheets have the same {what}")
        self.strings = self._strings(main)
        self.styles = Styles(self.package, main)
        self.names = {s.name.lower(): s for s in self.sheets}
        self._open: dict[int, Worksheet] = {}
        tables = [t for s in self.sheets for t in self.worksheet(s).tables] if any(self.package.related(s.part, "table") for s in self.sheets) else []
        if len({t["id"] for t in tables}) < len(tables) or len({t["name"].lower() for t in tables}) < len(tables):
            raise SheetError("table-duplicate", "two tables have the same id or name")

    def sheet(self, name: str | None = None) -> Sheet:
        """By name without case; else the first visible one, else the first."""
        if name is not None:
            found = self.names.get(name.lower())
            if found is None:
                raise SheetError("sheet-missing", f"there is no sheet {name!r}")
            return found
        return next((s for s in self.sheets if s.state == "visible"), self.sheets[0])

    def _strings(self, main: str) -> list[str]:
        found = self.package.related(main, "sharedStrings")
        if not found:
            return []
        root = xml(self.package.part(found[0][1]))
        out = [rich_text(e) for e in children(root, "si")]
        unique = integer(root, "uniqueCount")
        if unique is not None and unique != len(out):
            raise SheetError("shared-strings", f"uniqueCount is {unique}, but there are {len(out)} strings")
        return out

    def worksheet(self, sheet: Sheet) -> Worksheet:
        if sheet.id not in self._open:
            self._open[sheet.id] = self._read(sheet)
        return self._open[sheet.id]

    def _read(self, sheet: Sheet) -> Worksheet:
        root, out = xml(self.package.part(sheet.part)), Worksheet()
        for e in root:
            name = local(e)
            if name == "dimension":
                out.dimension = attribute(e, "ref")
            elif name == "sheetFormatPr":
                out.default_height, out.default_width = real(e, "defaultRowHeight", 15.0), real(e, "defaultColWidth", 8.43)
            elif name == "cols":
                out.columns += [{"min": integer(c, "min"), "max": integer(c, "max"), "width": real(c, "width"), "hidden": flag(c, "hidden"), "style": integer(c, "style")} for c in e]
            elif name == "sheetData":
                self._rows(e, out)
            elif name == "mergeCells":
                out.merges = [refs.parse_range(attribute(m, "ref")) for m in e]
                if _overlap(out.merges):
                    raise SheetError("merge-overlap", "merged ranges overlap")
            elif name == "sheetViews":
                out.panes += [dict(p.attrib) for v in e for p in children(v, "pane")]
            elif name == "sheetPr":
                color = child(e, "tabColor")
                out.tab_color = None if color is None else attribute(color, "rgb")
                out.tab = read_color(color)
            elif name == "hyperlinks":
                external = {r.id: r.target for r in self.package.rels.get(sheet.part, []) if r.external}
                for h in e:
                    rid = next((v for k, v in h.attrib.items() if k.endswith("}id")), None)
                    out.links.append({"box": refs.parse_range(attribute(h, "ref")), "location": attribute(h, "location"), "target": external.get(rid)})
        out.tables = self._tables(root, sheet)
        for _, p in self.package.related(sheet.part, "drawing"):
            out.anchors += read_anchors(xml(self.package.part(p)))
        return out

    def _tables(self, root: ET.Element, sheet: Sheet) -> list[dict]:
        """The tables that a sheet lists, each by a relationship of its own to a table part."""
        listed = [t for e in children(root, "tableParts") for t in children(e, "tablePart")]
        for e in children(root, "tableParts"):
            if integer(e, "count", len(listed)) != len(listed):
                raise SheetError("table-count", "the sheet lists another number of tables than it says")
        known = {r.id: p for r, p in self.package.related(sheet.part, "table")}
        ids = [next((v for k, v in t.attrib.items() if k.endswith("}id")), None) for t in listed]
        if len(set(ids)) < len(ids) or any(i not in known for i in ids) or len({known[i] for i in ids}) < len(ids):
            raise SheetError("table-relationship", "a table is listed twice or has no part")
        if any(self.package.content_type(known[i]) != TABLE for i in ids):
            raise SheetError("table-type", "a table's part has another content type")
        return [read_table(xml(self.package.part(known[i]))) for i in ids]

    def _rows(self, data: ET.Element, out: Worksheet) -> None:
        row = 0
        for r in children(data, "row"):
            row = integer(r, "r", row + 1)
            if row in out.rows or not 1 <= row <= refs.MAX_ROWS:
                raise SheetError("row", f"row {row} is repeated or outside the grid")
            out.rows[row] = {"height": real(r, "ht"), "hidden": flag(r, "hidden"), "style": integer(r, "s"), "custom_format": flag(r, "customFormat")}
            col = 0
            for c in children(r, "c"):
                ref = attribute(c, "r")
                at = refs.parse_cell(ref) if ref else refs.Address(row, col + 1)
                if at.row != row or (row, at.col) in out.cells:
                    raise SheetError("cell", f"{ref} is repeated or in the wrong row")
                col = at.col
                out.cells[row, col] = self._cell(c, row, col)

    def _cell(self, c: ET.Element, row: int, col: int) -> SheetCell:
        kind, f, v, inline = attribute(c, "t", "n"), child(c, "f"), child(c, "v"), child(c, "is")
        formula = None if f is None else f.text or ""
        locked = f is not None and attribute(f, "t", "normal") in ("shared", "array", "dataTable")
        text = None if v is None else v.text or ""
        out = SheetCell(row, col, BLANK, formula or None, integer(c, "s", 0), text, None, locked)
        if kind == "inlineStr":
            out.value, out.storage = Value("string", "" if inline is None else rich_text(inline)), "inline"
        elif text is None or (text == "" and kind != "str"):
            pass
        elif kind == "s":
            if not text.isdigit() or int(text) >= len(self.strings):
                raise SheetError("shared-string", f"there is no shared string {text}")
            out.value, out.storage = Value("string", self.strings[int(text)]), "shared"
        elif kind == "str":
            out.value, out.storage = Value("string", text), "formula"
        elif kind == "b":
            if text.lower() not in ("1", "0", "true", "false"):
                raise SheetError("cell-value", f"{text!r} is no boolean")
            out.value = Value("boolean", text.lower() in TRUE)
        elif kind in ("e", "d"):
            out.value = Value("error" if kind == "e" else "date", text)
        elif kind == "n":
            x = text_number(text)
            if x is None:
                raise SheetError("cell-value", f"{text!r} is no number")
            out.value = Value("number", x)
        else:
            raise SheetError("cell-type", f"unknown cell type {kind!r}")
        return out

    def formula_cells(self) -> dict:
        """All cells for calculation: (sheet id, row, col) to Cell. Shared and array formulas keep their cached value."""
        out = {}
        for s in self.sheets:
            for (row, col), c in self.worksheet(s).cells.items():
                value = c.value
                if value.tag == "error" and not str(value.value).startswith("#"):
                    value = Value("error", "#VALUE!")
                out[s.id, row, col] = Cell(value, None if c.locked else c.formula)
        return out

    def calculate(self, active: int | None = None):
        from quillgrid.plans.interpret import calculate

        return calculate(self.formula_cells(), {s.name: s.id for s in self.sheets}, active)


def _overlap(boxes: list) -> bool:
    """A sweep over the rows; the boxes that are open lie side by side in the order of columns."""
    events = sorted([(b.first.row, 1, b.first.col, b.last.col) for b in boxes] + [(b.last.row + 1, 0, b.first.col, b.last.col) for b in boxes])
    open_: list[tuple[int, int]] = []
    for _, begins, first, last in events:
        i = bisect_left(open_, (first, last))
        if not begins:
            open_.pop(i)
        elif i < len(open_) and open_[i][0] <= last or i and open_[i - 1][1] >= first:
            return True
        else:
            open_.insert(i, (first, last))
    return False


#: Fixed values of the format: theme slots by index, and the colours of the indexed palette.
SLOTS = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
CHART_SLOTS = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}
PALETTE = (
    "000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF", "000000", "FFFFFF", "FF0000", "00FF00", "0000FF", "FFFF00", "FF00FF", "00FFFF",
    "800000", "008000", "000080", "808000", "800080", "008080", "C0C0C0", "808080", "9999FF", "993366", "FFFFCC", "CCFFFF", "660066", "FF8080", "0066CC", "CCCCFF",
    "000080", "FF00FF", "FFFF00", "00FFFF", "800080", "800000", "008080", "0000FF", "00CCFF", "CCFFFF", "CCFFCC", "FFFF99", "99CCFF", "FF99CC", "CC99FF", "FFCC99",
    "3366FF", "33CCCC", "99CC00", "FFCC00", "FF9900", "FF6600", "666699", "969696", "003366", "339966", "003300", "333300", "993300", "993366", "333399", "333333",
)


def read_color(e: ET.Element | None) -> dict | None:
    """A colour as the file names it: rgb, theme or indexed with a tint; None for an automatic one."""
    if e is None or flag(e, "auto"):
        return None
    known = {k: attribute(e, k) for k in ("rgb", "theme", "indexed") if attribute(e, k) is not None}
    return {"rgb": known.get("rgb"), "theme": integer(e, "theme"), "indexed": integer(e, "indexed"), "tint": real(e, "tint", 0.0)} if known else None


def resolve_color(color: dict | None, theme: dict[str, str], palette: tuple[str, ...] = PALETTE) -> str | None:
    """The opaque ARGB of a colour, with its tint; None where it is automatic or its slot isn't there."""
    if color is None:
        return None
    if color["rgb"] is not None:
        rgb = color["rgb"][-6:]
    elif color["theme"] is not None:
        rgb = theme.get(SLOTS[color["theme"]]) if 0 <= color["theme"] < len(SLOTS) else None
    else:
        rgb = palette[color["indexed"]] if 0 <= color["indexed"] < len(palette) else None
    return None if rgb is None else "FF" + (tint(rgb, color["tint"]) if color["tint"] else rgb.upper())


def chart_color(kind: str, value: str, theme: dict[str, str]) -> str | None:
    """A chart's colour as #RRGGBB: an rgb value as it is, a scheme colour by its slot."""
    if kind == "rgb":
        return value
    slot = CHART_SLOTS.get(value, value if value in SLOTS else None)
    return f"#{theme[slot]}" if slot in theme else None


class Styles:
    """Cell formats resolved over their base styles."""

    def __init__(self, package: Package, main: str):
        self.formats, self.fonts, self.fills, self.borders, self.cells, self.bases = dict(BUILT_IN), [], [], [], [], []
        self.theme, self.palette = theme_colors(package, main), PALETTE
        found = package.related(main, "styles")
        if not found:
            return
        root = xml(package.part(found[0][1]))
        for e in root:
            name = local(e)
            if name == "numFmts":
                self.formats |= {integer(n, "numFmtId"): attribute(n, "formatCode") for n in e}
            elif name == "fonts":
                self.fonts = [{local(p): read_color(p) if local(p) == "color" else attribute(p, "val") or True for p in f} for f in e]
            elif name == "fills":
                self.fills = [{"pattern": attribute(p, "patternType"), "color": read_color(child(p, "fgColor"))} for f in e for p in f]
            elif name == "borders":
                self.borders = [{local(p): attribute(p, "style") for p in b} for b in e]
            elif name == "colors" and child(e, "indexedColors") is not None:
                self.palette = tuple(attribute(c, "rgb", "FF000000")[-6:] for c in child(e, "indexedColors"))
            elif name == "cellStyleXfs":
                self.bases = [self._xf(x) for x in e]
            elif name == "cellXfs":
                self.cells = [self._xf(x) for x in e]

    @staticmethod
    def _xf(x: ET.Element) -> dict:
        pick = {k: integer(x, a) for k, a in (("numFmt", "numFmtId"), ("font", "fontId"), ("fill", "fillId"), ("border", "borderId"))}
        apply = {k: attribute(x, f"apply{a}") for k, a in (("numFmt", "NumberFormat"), ("font", "Font"), ("fill", "Fill"), ("border", "Border"))}
        return {"ids": pick, "apply": {k: None if v is None else v.lower() in TRUE for k, v in apply.items()}, "base": integer(x, "xfId"), "wrap": any(flag(a, "wrapText") for a in children(x, "alignment"))}

    def resolved(self, style: int) -> dict:
        """Ids of number format, font, fill and border: the cell's own unless it says not to apply it, or says nothing and has none."""
        if not 0 <= style < len(self.cells):
            return {"numFmt": 0, "font": 0, "fill": 0, "border": 0}
        x = self.cells[style]
        base = self.bases[x["base"]]["ids"] if x["base"] is not None and x["base"] < len(self.bases) else {}
        out = {}
        for k, own in x["ids"].items():
            use_own = x["apply"][k] is True or (x["apply"][k] is None and own is not None)
            out[k] = own if use_own and own is not None else base.get(k, own) or 0
        return out

    def color(self, color: dict | None) -> str | None:
        return resolve_color(color, self.theme, self.palette)

    def fill(self, style: int) -> str | None:
        """The colour that a cell of this style is filled with."""
        i = self.resolved(style)["fill"]
        return self.color(self.fills[i]["color"]) if i < len(self.fills) and self.fills[i]["pattern"] == "solid" else None

    def format_code(self, style: int) -> str:
        return self.formats.get(self.resolved(style)["numFmt"], "General") or "General"


def read_table(root: ET.Element) -> dict:
    """A table: id, name, box, header and totals rows, columns, and its saved view."""
    box = refs.parse_range(attribute(root, "ref"))
    names = [attribute(c, "name") for c in children(child(root, "tableColumns"), "tableColumn")]
    if len(names) != box.last.col - box.first.col + 1:
        raise SheetError("table-width", "a table's columns differ from its width")
    filters, sorts = [], []
    auto = child(root, "autoFilter")
    if auto is not None:
        for f in children(auto, "filterColumn"):
            at, inner = integer(f, "colId"), next(iter(f), None)
            if inner is not None and local(inner) == "filters":
                filters.append({"kind": "values", "column": at, "values": [attribute(v, "val") for v in children(inner, "filter")], "blank": flag(inner, "blank")})
            elif inner is not None and local(inner) == "customFilters":
                filters.append({"kind": "custom", "column": at, "all": flag(inner, "and"), "conditions": [(attribute(v, "operator", "equal"), attribute(v, "val")) for v in children(inner, "customFilter")]})
                if not 1 <= len(filters[-1]["conditions"]) <= 2:
                    raise SheetError("table-filter", "a custom filter has one condition or two")
            else:
                filters.append({"kind": "unsupported", "column": at})
    state = child(root, "sortState")
    if state is None and auto is not None:
        state = child(auto, "sortState")
    if state is not None:
        for s in children(state, "sortCondition"):
            sorts.append({"column": refs.parse_range(attribute(s, "ref")).first.col - box.first.col, "descending": flag(s, "descending"), "case": flag(state, "caseSensitive"), "method": attribute(s, "sortBy", "value")})
    return {"id": integer(root, "id"), "name": attribute(root, "displayName") or attribute(root, "name"), "box": box, "header": integer(root, "headerRowCount", 1), "totals": integer(root, "totalsRowCount", 0), "columns": names, "filters": filters, "sorts": sorts, "by_columns": state is not None and flag(state, "columnSort")}


def body_rows(table: dict) -> range:
    return range(table["box"].first.row + table["header"], table["box"].last.row - table["totals"] + 1)


def read_anchors(root: ET.Element) -> list[dict]:
    """Drawing anchors with markers or positions in EMU, and the relationship of a chart inside."""
    marker = lambda e: None if e is None else {local(p): int(p.text) for p in e}
    out = []
    for a in root:
        if local(a) not in ("absoluteAnchor", "oneCellAnchor", "twoCellAnchor"):
            continue
        chart = next((v for e in a.iter() if local(e) == "chart" for k, v in e.attrib.items() if k.endswith("}id")), None)
        pos, ext = child(a, "pos"), child(a, "ext")
        out.append({"kind": local(a), "from": marker(child(a, "from")), "to": marker(child(a, "to")), "pos": None if pos is None else dict(pos.attrib), "ext": None if ext is None else dict(ext.attrib), "chart": chart})
        if len(out) > 10_000:
            raise SheetError("limit", "too many drawing anchors")
    return out


PROPERTIES = ("category", "contentStatus", "created", "creator", "description", "identifier", "keywords", "language", "lastModifiedBy", "lastPrinted", "modified", "revision", "subject", "title", "version")
W3CDTF = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d))?)?)?\Z")


def core_properties(package: Package) -> dict[str, str]:
    found = package.related("/", "core-properties")
    if not found:
        return {}
    out: dict[str, str] = {}
    for e in xml(package.part(found[0][1])):
        name = local(e)
        if name not in PROPERTIES or name in out:
            raise SheetError("core-properties", f"{name} is unknown or repeated")
        if name in ("created", "modified", "lastPrinted") and not W3CDTF.match((e.text or "").strip()):
            raise SheetError("core-properties", f"{name} is no date")
        out[name] = e.text or ""
    return out


def theme_fonts(package: Package, main: str) -> dict[str, dict[str, str]]:
    """Typefaces of the theme's major and minor fonts: latin, ea, cs, and by script."""
    found = package.related(main, "theme")
    scheme = next((e for e in xml(package.part(found[0][1])).iter() if local(e) == "fontScheme"), None) if found else None
    out = {}
    for kind in ("major", "minor") if scheme is not None else ():
        fonts = child(scheme, f"{kind}Font")
        out[kind] = {attribute(f, "script") or local(f): attribute(f, "typeface") for f in fonts if attribute(f, "typeface")} if fonts is not None else {}
    return out


def theme_colors(package: Package, main: str) -> dict[str, str]:
    found = package.related(main, "theme")
    if not found:
        return {}
    scheme = next((e for e in xml(package.part(found[0][1])).iter() if local(e) == "clrScheme"), None)
    return {} if scheme is None else {local(slot): attribute(c, "lastClr") or attribute(c, "val") for slot in scheme for c in slot}
