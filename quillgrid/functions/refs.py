"""A1 addresses: Python functions for plans, Column functions for data."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})\Z")


class Address(NamedTuple):
    row: int
    col: int


class Box(NamedTuple):
    first: Address
    last: Address

    def __contains__(self, at) -> bool:
        return self.first.row <= at[0] <= self.last.row and self.first.col <= at[1] <= self.last.col

    @property
    def cells(self) -> int:
        return (self.last.row - self.first.row + 1) * (self.last.col - self.first.col + 1)


def column_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def parse_cell(text: str) -> Address:
    m = CELL.match(text)
    if not m:
        raise ValueError(f"not a cell reference: {text!r}")
    at = Address(int(m[2]), column_number(m[1]))
    if at.row > MAX_ROWS or at.col > MAX_COLUMNS:
        raise ValueError(f"outside the grid: {text!r}")
    return at


def format_cell(at: Address) -> str:
    if not (1 <= at[0] <= MAX_ROWS and 1 <= at[1] <= MAX_COLUMNS):
        raise ValueError(f"outside the grid: {at!r}")
    return f"{column_letters(at[1])}{at[0]}"


def parse_range(text: str, normalise: bool = False) -> Box:
    """A1:B2, or one cell. Reversed corners are an error, or are put in order for formulas."""
    first, _, last = text.partition(":")
    a = parse_cell(first)
    b = parse_cell(last) if last or ":" in text else a
    if normalise:
        return Box(Address(min(a.row, b.row), min(a.col, b.col)), Address(max(a.row, b.row), max(a.col, b.col)))
    if b.row < a.row or b.col < a.col:
        raise ValueError(f"corners are reversed: {text!r}")
    return Box(a, b)


def format_range(box: Box) -> str:
    a, b = format_cell(box.first), format_cell(box.last)
    return a if a == b else f"{a}:{b}"


def parse_chart_reference(text: str, most: int = 100_000) -> tuple[str, Box] | None:
    """Sheet and range of a chart formula; None for what is no such reference or has too many cells."""
    text = text.strip().removeprefix("=")
    m = re.match(r"(?:'((?:[^']|'')+)'|([^'!\[\],]+))!(\$?[A-Za-z]{1,3}\$?[0-9]+(?::\$?[A-Za-z]{1,3}\$?[0-9]+)?)\Z", text)
    if not m or re.search(r"[\[\],]", text if m[2] else m[3]):
        return None
    try:
        box = parse_range(m[3], normalise=True)
    except ValueError:
        return None
    name = (m[1] or "").replace("''", "'") or m[2].strip()
    return (name, box) if box.cells <= most else None


def parse_location(text: str) -> tuple[str | None, str] | None:
    """Sheet and cell or range of a hyperlink's location, as #Sheet!A1 or A1."""
    text = text.strip().removeprefix("#")
    m = re.match(r"(?:(?:'((?:[^']|'')+)'|([^'!]+))!)?(\$?[A-Za-z]{1,3}\$?[0-9]+(?::\$?[A-Za-z]{1,3}\$?[0-9]+)?)\Z", text)
    if not m:
        return None
    try:
        box = parse_range(m[3])
    except ValueError:
        return None
    name = m[1].replace("''", "'") if m[1] else m[2]
    return name, format_range(box)


def a1_column(letters: Column) -> Column:
    """Number of a column's letters."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise((n * 26 + F.ascii(c) - 64).cast("int")))


def a1_parse(ref: Column) -> Column:
    """Struct row, col of a reference; null where it is none or lies outside the grid."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]{0,6})$"
    ok = ref.rlike(pattern)
    row = F.when(ok, F.regexp_extract(ref, pattern, 2).try_cast("int"))
    col = F.when(ok, a1_column(F.regexp_extract(ref, pattern, 1)))
    return F.when(ok & (row <= MAX_ROWS) & (col <= MAX_COLUMNS), F.struct(row.alias("row"), col.alias("col")))


def a1_range(ref: Column) -> Column:
    """Struct first, last (each row, col) and cells of a range or cell; null where it is none or its corners are reversed."""
    first, last = a1_parse(F.substring_index(ref, ":", 1)), a1_parse(F.substring_index(ref, ":", -1))
    box = F.struct(first.alias("first"), last.alias("last"))

    def sized(b):
        height, width = b["last"]["row"] - b["first"]["row"] + 1, b["last"]["col"] - b["first"]["col"] + 1
        ok = (height > 0) & (width > 0)
        return F.when(ok, F.struct(b["first"].alias("first"), b["last"].alias("last"), (height.cast("long") * width).alias("cells")))

    return F.transform(F.array(box), sized)[0]


def a1_letters(n: Column) -> Column:
    """Letters of a column's number, bijective in base 26."""
    digit = lambda x: F.chr(F.pmod(x - 1, F.lit(26)) + 65)
    second, third = F.floor((n - 1) / 26), F.floor((F.floor((n - 1) / 26) - 1) / 26)
    return F.concat(F.when(third > 0, digit(third)).otherwise(""), F.when(second > 0, digit(second)).otherwise(""), digit(n))


def a1_format(row: Column, col: Column) -> Column:
    return F.concat(a1_letters(col), row.cast("string"))
