"""New workbooks from cells: the XML of sheets, and packages of them."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from quillgrid.functions.refs import column_letters
from quillgrid.plans.formula import ERRORS

#: Fixed values of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006"


def cell_xml(ref: str, v, style: int | None = None) -> str:
    """A cell with a number, boolean, text or error, or a formula with its cached value."""
    start = f'<c r="{ref}"' + (f' s="{style}"' if style else "")
    if isinstance(v, tuple):
        formula, cached = v
        return f"{start}><f>{escape(formula)}</f>" + (f"<v>{cached}</v>" if cached is not None else "") + "</c>"
    if isinstance(v, bool):
        return f'{start} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, str):
        return f'{start} t="e"><v>{v}</v></c>' if v in ERRORS else f'{start} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
    return f"{start}><v>{v}</v></c>"


def sheet_xml(rows: dict[int, dict[str, object]], tail: str = "", head: str = "", attributes: dict[int, str] | None = None, styles: dict[str, int] | None = None) -> str:
    """A sheet from its rows' cells by column letters; attributes of rows, styles of cells by reference, and what comes before and after the cells."""
    own, styles = attributes or {}, styles or {}
    body = "".join(f'<row r="{r}"{own.get(r, "")}>' + "".join(cell_xml(f"{c}{r}", v, styles.get(f"{c}{r}")) for c, v in cells.items()) + "</row>" for r, cells in sorted(rows.items()))
    return f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">{head}<sheetData>{body}</sheetData>{tail}</worksheet>'


def workbook(sheets: dict[str, str], parts: dict[str, tuple[str, str]] | None = None, sheet_rels: dict[str, str] | None = None, main_rels: str = "", properties: str = "") -> bytes:
    """An .xlsx from the XML of its sheets, and other parts by name with content type and XML."""
    names = list(sheets)
    entries = {
        "_rels/.rels": f'<Relationships xmlns="{PKG}/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{properties}<sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PKG}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + main_rels + "</Relationships>",
    }
    for i, n in enumerate(names, 1):
        entries[f"xl/worksheets/sheet{i}.xml"] = sheets[n]
        if sheet_rels and n in sheet_rels:
            entries[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = f'<Relationships xmlns="{PKG}/relationships">{sheet_rels[n]}</Relationships>'
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
    for name, (kind, body) in (parts or {}).items():
        entries[name.lstrip("/")] = body
        types += f'<Override PartName="{name}" ContentType="{kind}"/>'
    entries["[Content_Types].xml"] = (
        f'<Types xmlns="{PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, body in entries.items():
            z.writestr(n, body)
    return out.getvalue()


def table_xml(id: int, name: str, ref: str, columns: list[str], tail: str = "") -> str:
    """A table part; tail holds its filters and sorts."""
    named = "".join(f"<tableColumn id={quoteattr(str(i))} name={quoteattr(c)}/>" for i, c in enumerate(columns, 1))
    return f'<table xmlns="{MAIN}" id="{id}" name={quoteattr(name)} displayName={quoteattr(name)} ref="{ref}">{tail}<tableColumns count="{len(columns)}">{named}</tableColumns></table>'


def from_rows(rows: list[tuple], tail: str = "", attributes: dict[int, str] | None = None, styles: dict[str, int] | None = None) -> str:
    """The XML of a sheet from (row, col, value or (formula, cached)), with its dimension."""
    by: dict[int, dict[str, object]] = {}
    for row, col, v in sorted(rows, key=lambda x: x[:2]):
        by.setdefault(row, {})[column_letters(col)] = v
    at, cols = sorted(by), [c for _, c, _ in rows]
    head = f'<dimension ref="{column_letters(min(cols))}{at[0]}:{column_letters(max(cols))}{at[-1]}"/>' if rows else ""
    return sheet_xml(by, tail, head, attributes, styles)
