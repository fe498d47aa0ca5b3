"""A small workbook made in memory, for tests and the calculation query."""

from __future__ import annotations

from quillgrid.sources.build import MAIN, PKG, REL, cell_xml, sheet_xml, workbook

__all__ = ["MAIN", "PKG", "REL", "calculated_demo", "cell_xml", "sample", "sheet_xml", "workbook"]


def sample() -> bytes:
    """Crates of fruit with a remark each and their sum, and a sheet that refers to it, with a function that isn't known and a cycle."""
    crates = {3: 40, 4: 21.5, 6: 8}
    rows = {r: {"C": n, "F": (f'IF(C{r}<25,"few","many")', None)} for r, n in crates.items()}
    return workbook({
        "Orchard 7": sheet_xml(rows | {9: {"E": ("SUM(C3:C6)", 1)}}),
        "Ledger": sheet_xml({2: {"A": ("'orchard 7'!E9/2", None), "B": ("HARVEST(A2)", 42), "C": ("B2+1", None)}, 3: {"A": ("B3+1", None), "B": ("A3+1", None)}}),
    })


def calculated_demo(spark):
    from quillgrid.sources import xlsx

    files = spark.createDataFrame([("sample.xlsx", bytearray(sample()))], "path string, content binary")
    rows = [(p, i, s, r, c, ref, st, f, *v) for p, i, s, r, c, ref, st, f, *v in xlsx.cell_rows("sample.xlsx", bytes(files.first()["content"]))]
    return xlsx.calculate_cells(spark.createDataFrame(rows, xlsx.CELLS)).select("sheet_id", "row", "col", "tag", "num", "str", "diagnostic")
