"""The view that a workbook saves with a table, applied to its cells."""

from __future__ import annotations

import re
from functools import cmp_to_key

from quillgrid.errors import SheetError
from quillgrid.functions.numfmt import format_value
from quillgrid.functions.scalars import BLANK, Value, compare, text_number
from quillgrid.functions.text import wildcard_pattern
from quillgrid.operators.tableview import ORDERED, CustomFilter, ValueFilter, saved_state
from quillgrid.sources.workbook import Workbook, Worksheet, body_rows


def shown(book: Workbook, sheet: Worksheet, row: int, col: int) -> str:
    """A cell's display text; blank where there is none."""
    c = sheet.cell((row, col))
    return "" if c is None else format_value(c.value, book.styles.format_code(c.style))


def keeps(f: ValueFilter | CustomFilter, text: str) -> bool:
    if isinstance(f, ValueFilter):
        return f.include_blank if text == "" else any(compare(Value("string", text), Value("string", v)) == 0 for v in f.values)
    found = []
    for c in f.conditions:
        if c.operator in ("equal", "notEqual"):
            hit = re.match(wildcard_pattern(c.value).replace(r"\z", r"\Z").replace("(?iu)", "(?is)"), text) is not None
            found.append(hit == (c.operator == "equal"))
            continue
        wanted = 0.0 if not c.value.strip() else text_number(c.value)
        mine = 0.0 if text == "" else text_number(text)
        both = (mine, wanted) if mine is not None and wanted is not None else (compare(Value("string", text), Value("string", c.value)), 0)
        found.append(ORDERED[c.operator](*both))
    return all(found) if f.all else any(found)


def projected(book: Workbook, sheet: Worksheet, table: dict) -> list[int]:
    """The sheet rows of a table's body that its saved filters keep, in the order of its saved sorts."""
    state = saved_state(table["filters"], table["sorts"], table["by_columns"])
    first = table["box"].first.col
    if any(not 0 <= x.column < len(table["columns"]) for x in (*state.filters, *state.sorts)):
        raise SheetError("table-view", "a filter or sort is outside the table")
    rows = [r for r in body_rows(table) if all(keeps(f, shown(book, sheet, r, first + f.column)) for f in state.filters)]

    def value(row: int, col: int) -> Value:
        c = sheet.cell((row, col))
        return BLANK if c is None else c.value

    for s in reversed(state.sorts):
        turn = -1 if s.descending else 1

        def order(a: int, b: int, col: int = first + s.column, turn: int = turn) -> int:
            x, y = value(a, col), value(b, col)
            if "blank" in (x.tag, y.tag):
                return turn * ((x.tag == "blank") - (y.tag == "blank"))
            return turn * compare(x, y)

        rows.sort(key=cmp_to_key(order))
    return rows
