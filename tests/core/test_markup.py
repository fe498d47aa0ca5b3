import io
import zipfile

import pytest

from quillgrid.errors import LimitError, SheetError
from quillgrid.functions.refs import parse_range
from quillgrid.operators.geometry import Pane, SparseAxis, formula_bar, frozen_extent
from quillgrid.operators.tableview import ViewState, check_editable
from quillgrid.sources import demo
from quillgrid.sources.build import table_xml
from quillgrid.sources.chartparts import read_chart, refreshed
from quillgrid.sources.markup import CompatibilityView, XmlEdit, edit_core_properties
from quillgrid.sources.package import Package, XmlLimits, xml
from quillgrid.sources.workbook import TABLE, Workbook, chart_color, core_properties, resolve_color, theme_colors, theme_fonts


def test_span_edits():
    data = b'<?xml version="1.0"?>\n<a k=\'1\'  z="x > y"><!-- kept --><b/> <c>old</c><d x="1"></d></a>'
    e = XmlEdit(data)
    b, c, d = e.root.children
    assert e.commit() is data or e.data == data
    e = XmlEdit(data)
    b, c, d = e.root.children
    e.set_text(b, "<1>")
    e.set_text(c, "new")
    e.set_attribute(e.root, "k", 'a"b')
    e.set_attribute(d, "y", "2")
    e.remove_attribute(d, "x")
    e.insert_before(c, "<before/>")
    e.append_element(e.root, "last", "t", {"n": "1"})
    assert e.commit() == b'<?xml version="1.0"?>\n<a k=\'a"b\'  z="x > y"><!-- kept --><b>&lt;1&gt;</b> <before/><c>new</c><d y="2"></d><last n="1">t</last></a>'
    e = XmlEdit(data)
    e.remove(e.root.find("c"))
    with pytest.raises(SheetError):
        e.set_text(e.root.find("c"), "x")
    e.replace(e.root.find("d"), "<e/>")
    assert e.commit().endswith(b"<b/> <e/></a>")
    with pytest.raises(SheetError):
        e.remove(e.root.children[0])
    e = XmlEdit(data)
    e.append(e.root, "<open>")
    with pytest.raises(SheetError):
        e.commit()
    assert XmlEdit('<?xml version="1.0" encoding="UTF-16"?><ü>1</ü>'.encode("utf-16")).root.name == "ü"


MC = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:n="urn:new" xmlns:o="urn:old" xmlns="urn:main"'


def names(view, e=None):
    return [c.tag.rpartition("}")[2] for c in view.children(view.root if e is None else e)]


def test_markup_compatibility():
    doc = f'<r {MC} mc:Ignorable="n o" mc:ProcessContent="n:wrap"><mc:AlternateContent><mc:Choice Requires="n"><x/></mc:Choice><mc:Choice Requires="o"><y/></mc:Choice><mc:Fallback><z/></mc:Fallback></mc:AlternateContent><n:gone><k/></n:gone><n:wrap><k/></n:wrap><l/></r>'.encode()
    assert names(CompatibilityView(doc, {"urn:main"})) == ["z", "k", "l"]
    assert names(CompatibilityView(doc, {"urn:main", "urn:old"})) == ["y", "k", "l"]
    assert names(CompatibilityView(doc, {"urn:main", "urn:new"})) == ["x", "gone", "wrap", "l"]
    for bad in (f'<r {MC} mc:MustUnderstand="n"/>', f'<r {MC}><mc:AlternateContent><mc:Fallback/></mc:AlternateContent></r>', f'<r {MC}><mc:AlternateContent><mc:Choice/></mc:AlternateContent></r>', f'<r {MC} mc:Ignorable="q"/>'):
        with pytest.raises(SheetError):
            CompatibilityView(bad.encode(), {"urn:main"})


def test_core_properties():
    data = demo.sample()
    assert edit_core_properties(data, {}) is data and edit_core_properties(data, {"title": None}) is data
    one = edit_core_properties(data, {"title": "A & B", "created": "2024-02-03T04:05:06Z", "category": "x"})
    assert core_properties(Package(one)) == {"title": "A & B", "created": "2024-02-03T04:05:06Z", "category": "x"}
    two = edit_core_properties(one, {"title": None, "category": "y", "creator": "me", "modified": "2024-02-04"})
    assert core_properties(Package(two)) == {"created": "2024-02-03T04:05:06Z", "category": "y", "creator": "me", "modified": "2024-02-04"}
    assert edit_core_properties(two, {"creator": "me"}) is two
    for bad in ({"color": "red"}, {"created": "yesterday"}):
        with pytest.raises(SheetError):
            edit_core_properties(data, bad)


def test_hostile_input():
    assert xml(b"<a><b/></a>").tag == "a"
    for bad, limits in ((b"<a>" * 300 + b"</a>" * 300, XmlLimits()), (b"<a><b/><b/></a>", XmlLimits(elements=2)), (b'<a x="1" y="2"/>', XmlLimits(attributes=1)), (b"<a>text</a>", XmlLimits(text=3)), (b"<a/>" + b" " * 9, XmlLimits(chars=8))):
        with pytest.raises(LimitError):
            xml(bad, limits)
    with pytest.raises(SheetError):
        xml(b"<!DOCTYPE a><a/>")
    with pytest.raises(SheetError):
        Package(demo.sample() + b"more")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", " " * 60_000)
    with pytest.raises(LimitError):
        Package(out.getvalue(), type(Package(demo.sample()).limits)(ratio=100))


THEME = '<a:theme xmlns:a="urn:a"><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:lt1><a:sysClr val="window" lastClr="FFFFFF"/></a:lt1><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme><a:fontScheme name="f"><a:majorFont><a:latin typeface="Big"/><a:ea typeface=""/></a:majorFont><a:minorFont><a:latin typeface="Small"/><a:font script="Jpan" typeface="Kana"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'


def test_colors_and_fonts():
    styles = f'<styleSheet xmlns="{demo.MAIN}"><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor theme="4" tint="0.4"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor indexed="10"/></patternFill></fill></fills><cellXfs><xf/><xf fillId="1"/><xf fillId="2"/></cellXfs></styleSheet>'
    rels = f'<Relationship Id="t" Type="{demo.REL}/theme" Target="theme.xml"/><Relationship Id="y" Type="{demo.REL}/styles" Target="styles.xml"/>'
    book = Workbook(demo.workbook({"S": demo.sheet_xml({1: {"A": 1}})}, {"/xl/theme.xml": ("application/t", THEME), "/xl/styles.xml": ("application/s", styles)}, main_rels=rels))
    assert [book.styles.fill(i) for i in range(3)] == [None, "FF8FAADC", "FFFF0000"]
    theme = theme_colors(book.package, book.package.main_part)
    assert resolve_color({"rgb": "00123456", "theme": None, "indexed": None, "tint": 0.0}, theme) == "FF123456"
    assert resolve_color({"rgb": None, "theme": 9, "indexed": None, "tint": 0.0}, theme) is None and resolve_color(None, theme) is None
    assert [chart_color("scheme", v, theme) for v in ("tx1", "bg1", "accent1", "accent2", "phClr")] == ["#000000", "#FFFFFF", "#4472C4", None, None] and chart_color("rgb", "#010203", {}) == "#010203"
    assert theme_fonts(book.package, book.package.main_part) == {"major": {"latin": "Big"}, "minor": {"latin": "Small", "Jpan": "Kana"}}


def test_hidden_rows_and_columns():
    sheet = f'<worksheet xmlns="{demo.MAIN}"><sheetFormatPr defaultRowHeight="15"/><cols><col min="2" max="3" width="10" hidden="1"/><col min="5" max="5" width="20"/></cols><sheetData><row r="2" hidden="1" ht="40"/><row r="4" ht="30"/></sheetData></worksheet>'
    book = Workbook(demo.workbook({"S": sheet}))
    w = book.worksheet(book.sheet())
    rows, cols = w.row_axis(), w.column_axis()
    assert [rows.size(i) for i in range(1, 5)] == [20, 0, 20, 40] and rows.start(5) == 80
    assert [cols.size(i) for i in (2, 3, 5)] == [0, 0, 140] and cols.size(1) == cols.size(4) == 59


def test_layout():
    rows, cols = SparseAxis(100, 20, {2: 0, 3: 50}), SparseAxis(50, 64, {1: 100})
    assert frozen_extent(rows, 3) == 70 and frozen_extent(cols, 0) == 0
    pane = Pane(rows, cols, 3, 1, 200, 300)
    assert pane.translation(2, 5) == (0, 200) and pane.translation(9, 1) == (300, 0) and pane.layer(9, 2) == 1 and pane.layer(9, 1) == 2
    found = pane.layout([10, 11], [4], [parse_range("A1:B3"), parse_range("D9:D10"), parse_range("F9:G9")])
    assert found["rows"] == [1, 3, 10, 11] and found["columns"] == [1, 4]
    assert [(m["left"], m["top"], m["width"], m["height"]) for m in found["merges"]] == [(0, 0, 164, 70), (228, 170, 64, 40)]
    at = lambda row, col: {"kind": "oneCellAnchor", "from": {"row": row, "col": col}}
    view, heads = (800, 600), (40, 24)
    assert pane.place({"kind": "absoluteAnchor"}, (500, 400, 50, 50), view, heads) == {"region": "body", "left": 540, "top": 424, "visible": True}
    assert pane.place(at(20, 9), (100, 100, 50, 50), view, heads)["visible"] is False
    assert pane.place(at(1, 0), (10, 20, 30, 30), view, heads) == {"region": "frozen-row", "left": 10, "top": 20, "visible": True}
    assert pane.place(at(1, 9), (500, 20, 30, 30), view, heads)["left"] == 200
    assert pane.place(at(20, 0), (10, 400, 30, 30), view, heads) == {"region": "frozen-column", "left": 10, "top": 130, "visible": True}
    with pytest.raises(ValueError):
        frozen_extent(rows, -1)


def test_edits_wait_for_plain_views():
    check_editable(ViewState())
    with pytest.raises(SheetError):
        check_editable(ViewState().sorted_by(1))


C = "http://schemas.openxmlformats.org/drawingml/2006/chart"


def chart_xml(plot, rest="", title=""):
    return f'<c:chartSpace xmlns:c="{C}" xmlns:a="urn:a"><c:chart>{title}<c:plotArea>{plot}{rest}</c:plotArea><c:legend><c:legendPos val="tr"/><c:overlay val="1"/></c:legend></c:chart></c:chartSpace>'.encode()


SERIES = """<c:ser><c:idx val="0"/><c:order val="1"/><c:tx><c:strRef><c:f>'Orchard 7'!F3</c:f><c:strCache><c:pt idx="0"><c:v>old</c:v></c:pt></c:strCache></c:strRef></c:tx><c:spPr><a:solidFill><a:srgbClr val="ab12cd"/></a:solidFill></c:spPr>
<c:cat><c:strRef><c:f>'Orchard 7'!F3:F6</c:f></c:strRef></c:cat><c:val><c:numRef><c:f>'orchard 7'!$C$3:$C$6</c:f><c:numCache><c:formatCode>0.0</c:formatCode><c:ptCount val="2"/><c:pt idx="1"><c:v>7</c:v></c:pt></c:numCache></c:numRef></c:val></c:ser>"""


def test_charts():
    axes = '<c:valAx><c:axId val="5"/><c:scaling><c:min val="-1"/><c:max val="9.5"/></c:scaling><c:delete val="0"/><c:axPos val="b"/><c:majorGridlines/><c:title><c:tx><c:rich><a:t>A</a:t><a:t>xis</a:t></c:rich></c:tx></c:title></c:valAx>'
    c = read_chart(xml(chart_xml(f'<c:barChart><c:barDir val="col"/><c:grouping val="clustered"/>{SERIES}</c:barChart>', axes)))
    assert (c["kind"], c["grouping"], c["legend"]) == ("column", "clustered", {"position": "top-right", "overlay": True})
    assert c["axes"] == [{"id": 5, "kind": "value", "position": "bottom", "title": "Axis", "gridlines": True, "min": -1.0, "max": 9.5, "deleted": False}]
    s = c["series"][0]
    assert (s["title"], s["fill"], s["values"]["points"], s["values"]["format"], s["line"]) == ("old", ("rgb", "#AB12CD"), {1: 7.0}, "0.0", None)
    live = refreshed(Workbook(demo.sample()), [c])[0]["series"][0]
    assert live["title"] == "many" and live["values"]["points"] == {0: 40.0, 1: 21.5, 3: 8.0} and live["categories"]["points"] == {0: "many", 1: "few", 2: "", 3: "few"}
    for plot, reason in (("<c:areaChart/>", "areaChart"), ("<c:barChart/><c:lineChart/>", "several kinds in one chart"), ('<c:lineChart><c:grouping val="percentStacked"/></c:lineChart>', "percentStacked"), (f"<c:pieChart>{SERIES}{SERIES}</c:pieChart>", "several series in a pie"), ("", "no kind of chart")):
        found = read_chart(xml(chart_xml(plot)))
        assert (found["kind"], found["reason"]) == ("unsupported", reason) and refreshed(Workbook(demo.sample()), [found]) == [found]
    assert read_chart(xml(chart_xml("<c:doughnutChart/>")))["hole"] == 50
    for bad in (SERIES.replace('idx="1"', 'idx="2"'), SERIES.replace(">7<", ">x<"), SERIES.replace("ab12cd", "ab"), SERIES.replace('<c:idx val="0"/>', "")):
        with pytest.raises(SheetError):
            read_chart(xml(chart_xml(f"<c:lineChart>{bad}</c:lineChart>")))


def test_formula_bar():
    assert formula_bar("=A1+1", "number") == ("formula", "A1+1") and formula_bar("12", "number") == ("value", 12.0) and formula_bar("", "string") == ("value", None)


def test_table_parts():
    sheet = f'<worksheet xmlns="{demo.MAIN}" xmlns:r="{demo.REL}"><sheetData/><tableParts count="1"><tablePart r:id="t"/></tableParts></worksheet>'
    make = lambda kind, xml_, rel="t": demo.workbook({"S": xml_}, {"/xl/tables/t.xml": (kind, table_xml(1, "T", "A1:B3", ["a", "b"]))}, {"S": f'<Relationship Id="{rel}" Type="{demo.REL}/table" Target="../tables/t.xml"/>'})
    book = Workbook(make(TABLE, sheet))
    assert [t["name"] for t in book.worksheet(book.sheet()).tables] == ["T"]
    for data in (make("application/x", sheet), make(TABLE, sheet, "u"), make(TABLE, sheet.replace('count="1"', 'count="2"'))):
        with pytest.raises(SheetError):
            book = Workbook(data)
            book.worksheet(book.sheet())
