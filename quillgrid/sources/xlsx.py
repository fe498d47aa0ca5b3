"""Workbooks in Spark: reading cells of many files, calculating them, and writing edits, one task for a file."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillgrid.errors import LimitError, SheetError
from quillgrid.functions import refs
from quillgrid.functions.scalars import Value
from quillgrid.plans.interpret import Cell, Limits, calculate
from quillgrid.sources import build
from quillgrid.sources.editor import Editor
from quillgrid.sources.package import TYPES, Package
from quillgrid.sources.workbook import Workbook

CELLS = "path string, sheet_id int, sheet string, row int, col int, ref string, style_index int, formula string, tag string, num double, str string, bool boolean, err string"
CALCULATED = "path string, sheet_id int, row int, col int, tag string, num double, str string, bool boolean, err string, diagnostic string"


def fields(v: Value | None) -> tuple:
    if v is None:
        return None, None, None, None, None
    x = v.value
    return v.tag, x if v.tag == "number" else None, x if v.tag in ("string", "date") else None, x if v.tag == "boolean" else None, x if v.tag == "error" else None


def cell_rows(path: str, data: bytes):
    book = Workbook(data)
    for s in book.sheets:
        for (row, col), c in sorted(book.worksheet(s).cells.items()):
            yield path, s.id, s.name, row, col, c.ref, c.style, None if c.locked else c.formula, *fields(c.value)


def opened(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """Rows that rows_of(path, bytes) gives for each of the files (path, content)."""
    kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(rows_of(path, data.as_buffer().to_pybytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """The files under a path, which may be in any store that Spark reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks under a path."""
    return cells_of(files_at(spark, path))


def cells_of(files: DataFrame) -> DataFrame:
    return opened(files, cell_rows, CELLS)


def each_sheet(data: bytes):
    book = Workbook(data)
    return ((book, s, book.worksheet(s)) for s in book.sheets)


def parts_of(files: DataFrame) -> DataFrame:
    """The parts of packages with their content types and sizes."""

    def rows(path, data):
        package = Package(data)
        return ((path, name, package.content_type(name), i.file_size) for name, i in package.infos.items() if name != TYPES)

    return opened(files, rows, "path string, part string, content_type string, bytes long")


def boxes_of(files: DataFrame) -> DataFrame:
    """The dimension, merged ranges, hyperlinks and tables of every sheet, as boxes."""

    def rows(path, data):
        for _, s, w in each_sheet(data):
            found = [("dimension", refs.parse_range(w.dimension), None)] if w.dimension else []
            found += [("merge", m, None) for m in w.merges] + [("link", x["box"], x["target"] or x["location"]) for x in w.links] + [("table", t["box"], t["name"]) for t in w.tables]
            for kind, box, text in found:
                yield path, s.name, kind, box.first.row, box.first.col, box.last.row, box.last.col, text

    return opened(files, rows, "path string, sheet string, kind string, row1 int, col1 int, row2 int, col2 int, text string")


def rows_of(files: DataFrame) -> DataFrame:
    """The rows of every sheet that are written, with height in pixels (0 if hidden) and the pixel they start at."""

    def rows(path, data):
        for _, s, w in each_sheet(data):
            axis = w.row_axis()
            yield from ((path, s.name, r, axis.size(r), axis.start(r)) for r in sorted(w.rows))

    return opened(files, rows, "path string, sheet string, row int, height double, start double")


def styles_of(files: DataFrame) -> DataFrame:
    """Every cell's number format and fill colour, through the cascade of its style."""

    def rows(path, data):
        for book, s, w in each_sheet(data):
            yield from ((path, s.name, row, col, book.styles.format_code(c.style), book.styles.fill(c.style)) for (row, col), c in sorted(w.cells.items()))

    return opened(files, rows, "path string, sheet string, row int, col int, format string, fill string")


def shown_of(files: DataFrame) -> DataFrame:
    """The rows that each table shows under its saved filters, in the order of its saved sorts: sheet row and slot (1, 2, ...)."""

    def rows(path, data):
        from quillgrid.sources.views import projected

        for book, s, w in each_sheet(data):
            for t in w.tables:
                for slot, row in enumerate(projected(book, w, t), 1):
                    yield path, t["name"], row, slot

    return opened(files, rows, "path string, table string, row int, slot int")


def to_workbooks(cells: DataFrame, tables: dict[str, tuple[str, list[str], str]] | None = None, styles: str | None = None) -> DataFrame:
    """path and content of new workbooks from cells (path, sheet, row, col, one of num, str, bool, formula, and if there, style, height and hidden of the cell's row).

    tables: for sheets by name, the name, columns and view (XML) of the table that all their cells make. styles: the styles part. A workbook is one group, as large as sheets may be."""
    more = [c for c in ("style", "height", "hidden") if c in cells.columns]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.astype(object).where(group.notna(), None)
        sheets: dict[str, tuple[list, dict, dict]] = {}
        for r in group.sort_values(["sheet", "row", "col"]).itertuples():
            v = (r.formula, None) if r.formula is not None else next((x for x in (r.num, r.str, r.bool) if x is not None), None)
            found, own, styled = sheets.setdefault(r.sheet, ([], {}, {}))
            if v is not None:
                found.append((int(r.row), int(r.col), v))
            if "style" in more and r.style:
                styled[refs.format_cell(refs.Address(int(r.row), int(r.col)))] = int(r.style)
            height = f' ht="{r.height}"' if "height" in more and r.height is not None else ""
            if height or "hidden" in more and r.hidden:
                own[int(r.row)] = height + (' hidden="1"' if "hidden" in more and r.hidden else "")
        parts, rels, xmls = {}, {}, {}
        for i, (name, (found, own, styled)) in enumerate(sheets.items(), 1):
            tail = ""
            if tables and name in tables:
                title, columns, view = tables[name]
                box = refs.Box(refs.Address(min(r for r, _, _ in found), min(c for _, c, _ in found)), refs.Address(max(r for r, _, _ in found), max(c for _, c, _ in found)))
                parts[f"/xl/tables/table{i}.xml"] = ("application/vnd.openxmlformats-officedocument.spreadsheetml.table+xml", build.table_xml(i, title, refs.format_range(box), columns, view))
                rels[name] = f'<Relationship Id="t1" Type="{build.REL}/table" Target="../tables/table{i}.xml"/>'
                tail = '<tableParts count="1"><tablePart r:id="t1"/></tableParts>'
            xmls[name] = build.from_rows(found, tail, own, styled)
        main = ""
        if styles:
            parts["/xl/styles.xml"] = ("application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml", styles)
            main = f'<Relationship Id="y1" Type="{build.REL}/styles" Target="styles.xml"/>'
        return pd.DataFrame([(group["path"].iloc[0], build.workbook(xmls, parts, rels, main))], columns=["path", "content"])

    return cells.select("path", "sheet", "row", "col", "num", "str", "bool", "formula", *more).groupBy("path").applyInPandas(run, "path string, content binary")


def calculate_cells(cells: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Calculated values and diagnostics of every formula; a workbook is one group, within the calculation's limits."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.astype(object).where(group.notna(), None)
        path, table, sheets = group["path"].iloc[0], {}, {}
        for r in group.itertuples():
            value = {"number": lambda r=r: r.num, "boolean": lambda r=r: bool(r.bool), "error": lambda r=r: r.err, "blank": lambda: None}.get(r.tag, lambda r=r: r.str)()
            table[r.sheet_id, r.row, r.col] = Cell(Value(r.tag, value), r.formula)
            sheets[r.sheet] = r.sheet_id
        out = calculate(table, sheets, limits=limits)
        rows = [(path, *at, *fields(v), None) for at, v in out.values.items()]
        rows += [(path, *at, *fields(None), code) for at, code in out.diagnostics.items() if at not in out.values]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CALCULATED.split(", ")])

    return cells.groupBy("path").applyInPandas(run, CALCULATED)


def with_calculated(cells: DataFrame, calculated: DataFrame) -> DataFrame:
    """Cells whose calculated value, where there is one, wins over the cached one."""
    new = calculated.where("tag IS NOT NULL").select("path", "sheet_id", "row", "col", F.struct("tag", "num", "str", "bool", "err").alias("new"))
    out = cells.join(new, ["path", "sheet_id", "row", "col"], "left")
    old = F.struct("tag", "num", "str", "bool", "err")
    return out.withColumn("value", F.coalesce("new", old)).select("path", "sheet_id", "sheet", "row", "col", "ref", "style_index", "formula", "value.*")


def write_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files: path, content. edits: path, sheet, ref, seq, and one of num, str, bool, formula (all null clears). The new content of each edited file."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in left.itertuples():
            e = Editor(bytes(r.content))
            for x in right.sort_values("seq").astype(object).where(lambda d: d.notna(), None).itertuples():
                if x.formula is not None:
                    e.set_formula(x.sheet, x.ref, x.formula)
                else:
                    e.set_value(x.sheet, x.ref, next((v for v in (x.num, x.str, x.bool) if v is not None), None))
            out.append((r.path, e.commit()))
        return pd.DataFrame(out, columns=["path", "content"])

    return files.groupBy("path").cogroup(edits.groupBy("path")).applyInPandas(run, "path string, content binary")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a path or URI lies in, and the path there; local ones are folders that all executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def workbooks_at(path: str) -> list[str]:
    """The .xlsx files of a folder, or the one file."""
    store, at = store_of(path)
    found = store.get_file_info([at])[0]
    if found.type == fs.FileType.NotFound:
        raise SheetError("source", f"there is nothing at {path}")
    return [at] if found.type == fs.FileType.File else sorted(x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".xlsx"))


class XlsxDataSource(DataSource):
    """spark.read.format("xlsx").load(path): the cells of the workbooks of a folder or of one file, a partition for each, read by the executors from any store that Arrow opens
    (read_cells reads also those that only Spark does). df.write.format("xlsx").save(path): a workbook from each task's rows, with a row of column names (option sheet names the sheet)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return XlsxReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return XlsxWriter(self.options["path"], schema.fieldNames(), self.options.get("sheet", "Sheet1"), overwrite)


class XlsxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(p) for p in workbooks_at(self.path)]

    def read(self, partition):
        store, _ = store_of(self.path)
        with store.open_input_stream(partition.value) as f:
            yield from cell_rows(partition.value, f.read())


@dataclass
class Written(WriterCommitMessage):
    path: str


class XlsxWriter(DataSourceWriter):
    """One new file for each task that has rows; files of failed tasks are removed."""

    def __init__(self, path: str, columns: list[str], sheet: str, overwrite: bool):
        self.path, self.columns, self.sheet = path, columns, sheet
        store, at = store_of(path)
        store.create_dir(at, recursive=True)
        old = workbooks_at(path)
        if old and not overwrite:
            raise SheetError("target", f"{path} has workbooks already")
        for f in old:
            store.delete_file(f)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        cells = [(1, i, name) for i, name in enumerate(self.columns, 1)]
        n = 1
        for row in rows:
            n += 1
            if n > refs.MAX_ROWS:
                raise LimitError("a sheet has no more rows: write with more tasks")
            for i, v in enumerate(row, 1):
                if v is not None:
                    cells.append((n, i, v if isinstance(v, (bool, str)) else float(v) if isinstance(v, (int, float, Decimal)) else str(v)))
        if n == 1:
            return Written("")
        context = TaskContext.get()
        store, at = store_of(self.path)
        path = f"{at}/part-{context.partitionId():05d}-{context.taskAttemptId()}.xlsx"
        with store.open_output_stream(path) as f:
            f.write(build.workbook({self.sheet: build.from_rows(cells)}))
        return Written(path)

    def commit(self, messages) -> None:
        kept = {m.path for m in messages if m is not None}
        for f in set(workbooks_at(self.path)) - kept:
            store_of(self.path)[0].delete_file(f)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path:
                store_of(self.path)[0].delete_file(m.path)
