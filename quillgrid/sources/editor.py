"""Editing of workbooks: staged cell values and formulas, committed by rewriting only the touched markup."""

from __future__ import annotations

import math
import re
from xml.sax.saxutils import escape, quoteattr

from quillgrid.errors import SheetError
from quillgrid.functions import refs
from quillgrid.functions.scalars import number_text
from quillgrid.plans.formula import parse
from quillgrid.sources.package import Transaction
from quillgrid.sources.workbook import Workbook

MAX_FORMULA = 8_192
ROW = re.compile(r"<(?P<p>\w+:)?row\b(?P<a>[^>]*?)(?:/>|>(?P<body>.*?)</(?P=p)?row>)".replace("(?P=p)?", r"(?:\w+:)?"), re.S)
CELL = re.compile(r"<(?:\w+:)?c\b(?P<a>[^>]*?)(?:/>|>(?P<body>.*?)</(?:\w+:)?c>)", re.S)


class Editor:
    """Stages edits of a workbook; the last edit of a cell wins."""

    def __init__(self, data: bytes):
        self.workbook, self.data, self.status = Workbook(data), data, "active"
        self.edits: dict[tuple[int, int, int], tuple[str, object]] = {}

    def _stage(self, sheet: str, ref: str, edit: tuple) -> None:
        if self.status != "active":
            raise SheetError("editor", f"the editor is {self.status}")
        s = self.workbook.sheet(sheet)
        at = refs.parse_cell(ref)
        old = self.workbook.worksheet(s).cell(at)
        if old is not None and old.locked:
            raise SheetError("formula-group", f"{ref} is part of a shared or array formula")
        self.edits[s.id, at.row, at.col] = edit

    def set_value(self, sheet: str, ref: str, value: str | float | bool | None) -> None:
        if isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isfinite(value):
            raise SheetError("cell-value", "a number must be finite")
        self._stage(sheet, ref, ("value", value))

    def set_formula(self, sheet: str, ref: str, formula: str) -> None:
        if len(formula) > MAX_FORMULA:
            raise SheetError("formula-length", f"a formula may have {MAX_FORMULA} characters")
        parse(formula)
        self._stage(sheet, ref, ("formula", formula))

    def rollback(self) -> None:
        if self.status != "active":
            raise SheetError("editor", f"the editor is {self.status}")
        self.status = "rolled-back"

    def commit(self) -> bytes:
        if self.status != "active":
            raise SheetError("editor", f"the editor is {self.status}")
        package = self.workbook.package
        t = Transaction(package)
        for s in self.workbook.sheets:
            mine = {(r, c): e for (sid, r, c), e in sorted(self.edits.items()) if sid == s.id and self._changes(s, r, c, e)}
            if mine:
                t.replace_part(s.part, self._rewrite(package.part(s.part).decode("utf-8"), s, mine).encode())
        if t.replaced:
            self._invalidate(t)
        out = t.commit()
        self.status = "committed"
        return out

    def _changes(self, sheet, row: int, col: int, edit: tuple) -> bool:
        old = self.workbook.worksheet(sheet).cells.get((row, col))
        kind, new = edit
        if kind == "formula":
            return old is None or old.formula != new
        if new is None:
            return old is not None and (old.value.tag != "blank" or old.formula is not None)
        tag = "boolean" if isinstance(new, bool) else "string" if isinstance(new, str) else "number"
        return old is None or old.formula is not None or (old.value.tag, old.value.value) != (tag, new)

    def _invalidate(self, t: Transaction) -> None:
        """Drops the calculation chain and asks readers to calculate in full."""
        package, main = self.workbook.package, self.workbook.package.main_part
        for r, part in package.related(main, "calcChain"):
            t.remove_relationship(main, r.id)
            t.remove_part(part)
        text = t.part(main).decode("utf-8")
        wanted = ' fullCalcOnLoad="1" forceFullCalc="1"'
        if m := re.search(r"<(?:\w+:)?calcPr\b[^>]*?(?=/?>)", text):
            kept = re.sub(r'\s(?:fullCalcOnLoad|forceFullCalc)="[^"]*"', "", m[0])
            text = text[: m.start()] + kept.rstrip() + wanted + text[m.end() :]
        else:
            prefix = re.search(r"</(\w+:)?workbook>", text)
            at = re.search(r"</(?:\w+:)?(?:definedNames|externalReferences|functionGroups|sheets)>(?!.*</(?:\w+:)?(?:definedNames|externalReferences|functionGroups|sheets)>)", text, re.S)
            text = text[: at.end()] + f"<{prefix[1] or ''}calcPr{wanted}/>" + text[at.end() :]
        t.replace_part(main, text.encode())

    def _markup(self, p: str, row: int, col: int, edit: tuple, style: str) -> str:
        ref, (kind, v) = refs.format_cell(refs.Address(row, col)), edit
        if kind == "formula":
            return f'<{p}c r="{ref}"{style}><{p}f>{escape(v)}</{p}f></{p}c>'
        if v is None:
            return f'<{p}c r="{ref}"{style}/>'
        if isinstance(v, bool):
            return f'<{p}c r="{ref}"{style} t="b"><{p}v>{int(v)}</{p}v></{p}c>'
        if isinstance(v, str):
            return f'<{p}c r="{ref}"{style} t="inlineStr"><{p}is><{p}t xml:space="preserve">{escape(v)}</{p}t></{p}is></{p}c>'
        return f'<{p}c r="{ref}"{style}><{p}v>{number_text(v)}</{p}v></{p}c>'

    def _rewrite(self, text: str, sheet, edits: dict) -> str:
        m = re.search(r"<(?P<p>\w+:)?sheetData\b[^>]*?(?:/>|>(?P<body>.*?)</(?:\w+:)?sheetData>)", text, re.S)
        p, body = m["p"] or "", m["body"] or ""
        by_row: dict[int, dict[int, tuple]] = {}
        for (r, c), e in edits.items():
            by_row.setdefault(r, {})[c] = e
        out, at, number = [], 0, 0
        pending = sorted(by_row)

        def new_row(r: int) -> str:
            return f'<{p}row r="{r}">' + "".join(self._markup(p, r, c, e, "") for c, e in sorted(by_row[r].items()) if e != ("value", None)) + f"</{p}row>"

        for found in ROW.finditer(body):
            r = re.search(r'(?:^|\s)r="(\d+)"', found["a"])
            number = int(r[1]) if r else number + 1
            out.append(body[at : found.start()])
            while pending and pending[0] < number:
                out.append(new_row(pending.pop(0)))
            if pending and pending[0] == number:
                pending.pop(0)
                out.append(f"<{p}row{found['a'].rstrip()}>" + self._cells(p, found["body"] or "", number, by_row[number]) + f"</{p}row>")
            else:
                out.append(found[0])
            at = found.end()
        out.append(body[at:])
        out += [new_row(r) for r in pending]
        text = text[: m.start()] + f"<{p}sheetData>" + "".join(out) + f"</{p}sheetData>" + text[m.end() :]
        grown = [k for k, e in edits.items() if e != ("value", None)]
        return self._grow(text, grown)

    def _cells(self, p: str, body: str, row: int, edits: dict) -> str:
        out, at, col = [], 0, 0
        pending = sorted(edits)
        for found in CELL.finditer(body):
            r = re.search(r'(?:^|\s)r="([^"]+)"', found["a"])
            col = refs.parse_cell(r[1]).col if r else col + 1
            out.append(body[at : found.start()])
            while pending and pending[0] < col:
                c = pending.pop(0)
                if edits[c] != ("value", None):
                    out.append(self._markup(p, row, c, edits[c], ""))
            if pending and pending[0] == col:
                style = re.search(r'\ss="\d+"', found["a"])
                out.append(self._markup(p, row, col, edits[pending.pop(0)], style[0] if style else ""))
            else:
                out.append(found[0])
            at = found.end()
        out.append(body[at:])
        return "".join(out) + "".join(self._markup(p, row, c, edits[c], "") for c in pending if edits[c] != ("value", None))

    @staticmethod
    def _grow(text: str, cells: list) -> str:
        m = re.search(r'(<(?:\w+:)?dimension\b[^>]*?ref=)"([^"]*)"', text)
        if not m or not cells:
            return text
        box = refs.parse_range(m[2])
        a = refs.Address(min([box.first.row, *(r for r, _ in cells)]), min([box.first.col, *(c for _, c in cells)]))
        b = refs.Address(max([box.last.row, *(r for r, _ in cells)]), max([box.last.col, *(c for _, c in cells)]))
        return text[: m.start()] + m[1] + quoteattr(refs.format_range(refs.Box(a, b))) + text[m.end() :]


class Artifact:
    """A workbook with its calculation: edits give a new one."""

    def __init__(self, data: bytes, sheet: str | None = None):
        self.bytes, self.workbook = data, Workbook(data)
        self.sheet = self.workbook.sheet(sheet)
        self.calculation = self.workbook.calculate(self.sheet.id)

    def value(self, ref: str):
        at = refs.parse_cell(ref)
        known = self.calculation.values.get((self.sheet.id, *at))
        if known is not None:
            return known
        cell = self.workbook.worksheet(self.sheet).cell(at)
        return None if cell is None else cell.value

    def display(self, ref: str) -> str:
        from quillgrid.functions.numfmt import format_value
        from quillgrid.functions.scalars import BLANK

        cell = self.workbook.worksheet(self.sheet).cell(refs.parse_cell(ref))
        code = self.workbook.styles.format_code(cell.style if cell else 0)
        return format_value(self.value(ref) or BLANK, code, date1904=self.workbook.date1904)

    def edit_cell(self, ref: str, value) -> Artifact:
        e = Editor(self.bytes)
        e.set_value(self.sheet.name, ref, value)
        return Artifact(e.commit(), self.sheet.name)

    def edit_formula(self, ref: str, formula: str) -> Artifact:
        e = Editor(self.bytes)
        e.set_formula(self.sheet.name, ref, formula)
        return Artifact(e.commit(), self.sheet.name)
