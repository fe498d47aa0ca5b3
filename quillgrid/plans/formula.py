"""The formula language: tokens, and a precedence parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillgrid.errors import FormulaParseError
from quillgrid.functions.refs import MAX_COLUMNS, MAX_ROWS, Address, Box, column_number

#: Fixed values of the format.
ERRORS = ("#DIV/0!", "#VALUE!", "#NULL!", "#REF!", "#NAME?", "#NUM!", "#N/A")
FUNCTIONS = ("IF", "SUM", "COUNT", "AVERAGE", "MIN", "MAX", "AND", "OR", "NOT")
#: Binary operators from the loosest to the tightest; those of a line group to the left. Signs bind tighter, the percent sign tightest.
LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))
RANK = {op: i for i, line in enumerate(LEVELS) for op in line}


@dataclass(frozen=True)
class Literal:
    kind: str  # number, string, boolean or error
    value: object


@dataclass(frozen=True)
class Ref:
    sheet: str | None
    at: Address
    fixed: bool = False  # a dollar sign before the row


@dataclass(frozen=True)
class Range:
    sheet: str | None
    box: Box
    fixed: tuple[bool, bool] = (False, False)


@dataclass(frozen=True)
class Prefix:
    op: str
    x: object


@dataclass(frozen=True)
class Percent:
    x: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<string>"(?:[^"]|"")*")
    |(?P<sheet>'(?:[^']|'')+'(?=!))
    |(?P<error>\#(?:DIV/0!|VALUE!|NULL!|REF!|NAME\?|NUM!|N/A))
    |(?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<name>\$?[A-Za-z_][A-Za-z0-9_.$]*)
    |(?P<symbol><>|<=|>=|[-+*/^&=<>%(),:!])""",
    re.VERBOSE,
)
CELL = re.compile(r"\$?([A-Za-z]{1,3})(\$?)([1-9][0-9]*)\Z")


def tokens(text: str) -> list[tuple[str, str, int]]:
    """Kind, text and place of each token, ending with an end token."""
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaParseError(f"unexpected {text[at]!r}", at)
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return [*out, ("end", "", at)]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = tokens(text), 0

    def peek(self) -> tuple[str, str, int]:
        return self.tokens[self.i]

    def take(self, text: str | None = None) -> tuple[str, str, int]:
        t = self.tokens[self.i]
        if text is not None and t[1] != text:
            raise FormulaParseError(f"expected {text!r}, found {t[1] or 'the end'!r}", t[2])
        self.i += 1
        return t

    def expression(self):
        """Operands and operators in a row; an operator is applied as soon as a looser one, or one of its own line, follows."""
        values, waiting = [self.signed()], []

        def apply():
            right, left = values.pop(), values.pop()
            values.append(Binary(waiting.pop(), left, right))

        while self.peek()[0] == "symbol" and self.peek()[1] in RANK:
            op = self.take()[1]
            while waiting and RANK[waiting[-1]] >= RANK[op]:
                apply()
            waiting.append(op)
            values.append(self.signed())
        while waiting:
            apply()
        return values[0]

    def signed(self):
        signs = []
        while self.peek()[0] == "symbol" and self.peek()[1] in ("+", "-"):
            signs.append(self.take()[1])
        out = self.operand()
        while self.peek()[1] == "%" and self.peek()[0] == "symbol":
            self.take()
            out = Percent(out)
        for op in reversed(signs):
            out = Prefix(op, out)
        return out

    def operand(self):
        kind, text, at = self.take()
        if kind == "number":
            value = float(text)
            if value == float("inf"):
                raise FormulaParseError("a number is too large", at)
            return Literal("number", value)
        if kind in ("string", "error"):
            return Literal(kind, text[1:-1].replace('""', '"') if kind == "string" else text)
        if kind == "symbol" and text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "sheet":
            self.take("!")
            return self.reference(text[1:-1].replace("''", "'"))
        if kind != "name":
            raise FormulaParseError(f"unexpected {text or 'end'!r}", at)
        after = self.peek()[1]
        if after == "(":
            return self.call(text)
        if after == "!":
            self.take()
            return self.reference(text)
        if text.upper() in ("TRUE", "FALSE"):
            return Literal("boolean", text.upper() == "TRUE")
        self.i -= 1
        return self.reference(None)

    def call(self, name: str):
        self.take("(")
        args = []
        if self.peek()[1] != ")":
            args.append(self.expression())
            while self.peek()[1] == ",":
                self.take()
                args.append(self.expression())
        self.take(")")
        return Call(name.upper(), tuple(args))

    def cell(self) -> tuple[Address, bool]:
        """An address, and whether its row is fixed."""
        kind, text, at = self.take()
        m = CELL.match(text) if kind == "name" else None
        if not m:
            raise FormulaParseError(f"{text or 'the end'!r} is no reference", at)
        out = Address(int(m[3]), column_number(m[1]))
        if out.row > MAX_ROWS or out.col > MAX_COLUMNS:
            raise FormulaParseError(f"{text!r} lies outside the grid", at)
        return out, bool(m[2])

    def reference(self, sheet: str | None):
        first, fixed = self.cell()
        if self.peek()[1] != ":":
            return Ref(sheet, first, fixed)
        self.take()
        last, also = self.cell()
        if first.row > last.row:
            fixed, also = also, fixed
        return Range(sheet, Box(Address(min(first.row, last.row), min(first.col, last.col)), Address(max(first.row, last.row), max(first.col, last.col))), (fixed, also))


def parse(text: str):
    """The syntax tree of a formula, written without the leading equals sign."""
    p = Parser(text)
    try:
        out = p.expression()
    except RecursionError:
        raise FormulaParseError("brackets are nested too deeply", p.peek()[2]) from None
    kind, found, at = p.peek()
    if kind != "end":
        raise FormulaParseError(f"unexpected {found!r}", at)
    return out


def references(tree) -> list:
    """All Ref and Range nodes in order, also those of branches that are never taken."""
    if isinstance(tree, (Ref, Range)):
        return [tree]
    if isinstance(tree, (Prefix, Percent)):
        return references(tree.x)
    if isinstance(tree, Binary):
        return references(tree.left) + references(tree.right)
    if isinstance(tree, Call):
        return [r for a in tree.args for r in references(a)]
    return []
