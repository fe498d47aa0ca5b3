import io
import zipfile

import pytest

from quillgrid.errors import SheetError
from quillgrid.functions.scalars import Value
from quillgrid.operators import geometry
from quillgrid.operators.charts import arc_path, nice_step
from quillgrid.sources import demo, xlsx
from quillgrid.sources.editor import Artifact, Editor
from quillgrid.sources.package import Package, Relationship, Transaction
from quillgrid.sources.workbook import Workbook


def test_sample_calculation():
    a = Artifact(demo.sample())
    assert [a.display(c) for c in ("F3", "F4", "F6", "E9")] == ["many", "few", "few", "69.5"]
    assert a.edit_cell("C3", 20.0).display("E9") == "49.5"
    other = Artifact(demo.sample(), "ledger")
    assert other.value("A2") == Value("number", 34.75) and other.value("C2") == Value("number", 43.0)
    assert other.calculation.diagnostics[2, 3, 1] == "circular-reference"


def test_every_cell_type():
    sheet = (
        f'<worksheet xmlns="{demo.MAIN}"><dimension ref="A2:H3"/><sheetData><row r="2"><c r="A2"><f>1+1</f><v>2</v></c><c t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c>'
        '<c r="D2" t="b"><v>1</v></c><c r="E2" t="e"><v>#N/A</v></c><c r="F2" t="d"><v>2020-01-01</v></c><c r="G2" t="str"><f>"x"</f><v>x</v></c><c r="H2"/></row><row><c><v>7</v></c></row></sheetData><mergeCells><mergeCell ref="A5:B6"/></mergeCells></worksheet>'
    )
    strings = f'<sst xmlns="{demo.MAIN}" uniqueCount="1"><si><t>shared</t></si></sst>'
    data = demo.workbook({"S": sheet}, {"/xl/sharedStrings.xml": ("application/x", strings)}, main_rels=f'<Relationship Id="q" Type="{demo.REL}/sharedStrings" Target="sharedStrings.xml"/>')
    w = Workbook(data).worksheet(Workbook(data).sheet())
    assert [w.cell(c).value for c in ("A2", "B2", "C2", "D2", "E2", "F2", "G2", "H2", "A3")] == [Value("number", 2.0), Value("string", "shared"), Value("string", "ab"), Value("boolean", True), Value("error", "#N/A"), Value("date", "2020-01-01"), Value("string", "x"), Value("blank"), Value("number", 7.0)]
    assert w.merges[0].cells == 4


@pytest.mark.parametrize(
    "rows",
    ['<row r="1"><c r="A1"/><c r="A1"/></row>', '<row r="1"/><row r="1"/>', '<row r="1"><c r="A2"/></row>', '<row r="1"><c r="A1" t="s"><v>5</v></c></row>', '<row r="1"><c r="A1"><v>x</v></c></row>', '<!DOCTYPE a><row r="1"/>'],
)
def test_bad_sheets(rows):
    book = Workbook(demo.workbook({"S": f'<worksheet xmlns="{demo.MAIN}"><sheetData>{rows}</sheetData></worksheet>'}))
    with pytest.raises(SheetError):
        book.worksheet(book.sheet())


def test_bad_packages():
    with pytest.raises(SheetError):
        Package(b"PK\3\4 no zip")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", "<a/>")
    with pytest.raises(SheetError):
        Package(out.getvalue())


def test_editing():
    data = demo.sample()
    e = Editor(data)
    e.set_value("orchard 7", "C3", 40.0)
    assert e.commit() is data  # nothing changes
    e = Editor(data)
    for ref, v in (("C3", 1.5), ("A1", "<x> & y"), ("Z99", True), ("C4", None), ("Q1", None)):
        e.set_value("Orchard 7", ref, v)
    e.set_formula("Orchard 7", "E9", "SUM(C3:C6)*2")
    new = e.commit()
    w = Workbook(new).worksheet(Workbook(new).sheet())
    assert [w.cell(c).value for c in ("C3", "A1", "Z99", "C4")] == [Value("number", 1.5), Value("string", "<x> & y"), Value("boolean", True), Value("blank")]
    assert w.cell("Q1") is None and w.cell("E9").formula == "SUM(C3:C6)*2" and w.cell("C6").value == Value("number", 8.0)
    assert b"fullCalcOnLoad" in Package(new).part("/xl/workbook.xml")
    assert Package(new).raw("/xl/worksheets/sheet2.xml") == Package(data).raw("/xl/worksheets/sheet2.xml")
    with pytest.raises(SheetError):
        e.set_value("Orchard 7", "A1", 1)
    for bad in (lambda e: e.set_value("S", "A1", 1), lambda e: e.set_value("Ledger", "A1", float("nan")), lambda e: e.set_formula("Ledger", "A1", "1" * 9000), lambda e: e.set_formula("Ledger", "A1", "=1")):
        with pytest.raises(SheetError):
            bad(Editor(data))


def test_transactions():
    p = Package(demo.sample())
    t = Transaction(p)
    t.add_part("/docProps/x.xml", "application/test", b"<x/>")
    t.add_relationship("/", Relationship("r9", "http://x/y", "docProps/x.xml"))
    q = Package(t.commit())
    assert q.content_type("/docProps/x.xml") == "application/test" and q.part("/docProps/x.xml") == b"<x/>"
    t = Transaction(q)
    t.remove_part("/docProps/x.xml")
    with pytest.raises(SheetError, match="still points"):
        t.commit()
    t.remove_relationship("/", "r9")
    assert "/docProps/x.xml" not in Package(t.commit()).infos
    with pytest.raises(SheetError):
        t.rollback()


def test_spark_reading_and_calculation(spark, tmp_path):
    path = tmp_path / "a.xlsx"
    path.write_bytes(demo.sample())
    cells = xlsx.read_cells(spark, str(path))
    assert cells.count() == 12
    calculated = xlsx.calculate_cells(cells)
    merged = {(r.sheet, r.ref): r for r in xlsx.with_calculated(cells, calculated).collect()}
    assert merged["Orchard 7", "E9"].num == 69.5 and merged["Ledger", "C2"].num == 43 and merged["Ledger", "B2"].num == 42
    spark.dataSource.register(xlsx.XlsxDataSource)
    assert spark.read.format("xlsx").load(str(path)).count() == 12
    files = spark.read.format("binaryFile").load(str(path)).select("path", "content")
    edits = files.selectExpr("path", "'Ledger' AS sheet", "'D4' AS ref", "1 AS seq", "2.5D AS num", "CAST(NULL AS STRING) AS str", "CAST(NULL AS BOOLEAN) AS bool", "CAST(NULL AS STRING) AS formula")
    new = xlsx.write_edits(files, edits).first()
    book = Workbook(bytes(new.content))
    assert book.worksheet(book.sheet("ledger")).cell("D4").value == Value("number", 2.5)


def test_geometry(spark):
    a = geometry.SparseAxis(1_048_576, 20, {2: 40, 4: 0, 1_048_576: 30})
    assert (a.start(3), a.start(5), a.index_at(79), a.index_at(80), a.total) == (60, 80, 3, 5, 20_971_530)
    assert geometry.Selection(5, 5, 2, 9).box == (2, 5, 5, 9) and geometry.Selection(1, 1, 1, 1).move(-3, 4, 10, 3).box == (1, 3, 1, 3)
    assert nice_step(25, 5) == 5 and nice_step(0, 5) == 1 and arc_path(0, 0, 1, 0, 1).startswith("M 0.000 0.000 L")
    assert geometry.tint("4472C4", 0.0) == "4472C4" and geometry.tint("000000", 0.5) == "808080" and geometry.tint("FF0000", -0.5) == "800000"
    from pyspark.sql import functions as F

    colors = [("4472C4", 0.4), ("4472C4", -0.25), ("FFFFFF", -0.15), ("123456", 0.8)]
    df = spark.createDataFrame([(*(int(c[i : i + 2], 16) for i in (0, 2, 4)), t) for c, t in colors], "r int, g int, b int, t double")
    assert [r[0] for r in df.select(geometry.tint_column(F.col("r"), F.col("g"), F.col("b"), F.col("t"))).collect()] == [geometry.tint(c, t) for c, t in colors]
    assert [geometry.edit_coercion(*x) for x in (("", "number"), ("12", "number"), ("12", "string"), ("true", "boolean"), ("abc", "number"))] == [None, 12.0, "12", True, "abc"]


def test_sink(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.dataSource.register(xlsx.XlsxDataSource)
    df = spark.range(10).selectExpr("CAST(id AS DOUBLE) AS n", "concat('<', id, '>') AS t", "id % 2 = 0 AS even", "CAST(NULL AS STRING) AS none").repartition(2)
    df.write.format("xlsx").option("sheet", "Data").mode("append").save(path)
    cells = spark.read.format("xlsx").load(path)
    got = {(r.path, r.row): {} for r in cells.collect()}
    for r in cells.collect():
        got[r.path, r.row][r.col] = r.num if r.tag == "number" else r.str if r.tag == "string" else r.bool
    assert {r.sheet for r in cells.collect()} == {"Data"} and all(v == {1: "n", 2: "t", 3: "even", 4: "none"} for (_, row), v in got.items() if row == 1)
    assert sorted((v[1], v[2], v[3]) for (_, row), v in got.items() if row > 1) == [(float(i), f"<{i}>", i % 2 == 0) for i in range(10)]
    with pytest.raises(Exception, match="workbooks already"):
        df.write.format("xlsx").mode("append").save(path)
    df.where("n < 0").write.format("xlsx").mode("overwrite").save(path)
    assert not list((tmp_path / "out").glob("*.xlsx"))
