"""Column mode: formulas as Spark columns, filled down a table or summed up over it.

A value is up to four columns (number, text, boolean, error), of which at most one is not null; all null is blank. Fields that a
formula can never yield are left out, so plain arithmetic on a number column stays one expression for Catalyst.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.errors import SheetError
from quillgrid.functions.refs import Box
from quillgrid.functions.text import natural_key, number_text, text_number
from quillgrid.plans.formula import FUNCTIONS, Binary, Call, Literal, Percent, Prefix, Range, Ref, parse, references

#: A range that ends in the last row of the grid takes the whole column.
LAST_ROW = 1_048_576


@dataclass(frozen=True)
class Col:
    num: Column | None = None
    str: Column | None = None
    bool: Column | None = None
    err: Column | None = None

    @property
    def tag(self) -> Column:
        out = F.lit(None).cast("string")
        for name, c in (("number", self.num), ("string", self.str), ("boolean", self.bool), ("error", self.err)):
            if c is not None:
                out = F.when(c.isNotNull(), name).otherwise(out)
        return F.coalesce(out, F.lit("blank"))

    @property
    def text(self) -> Column:
        """As text is coerced; errors are null."""
        parts = [] if self.num is None else [number_text(self.num)]
        parts += [] if self.str is None else [self.str]
        parts += [] if self.bool is None else [F.when(self.bool, "TRUE").when(~self.bool, "FALSE")]
        return F.coalesce(*parts, F.lit(""))

    @property
    def display(self) -> Column:
        return self.text if self.err is None else F.coalesce(self.err, self.text)

    def struct(self) -> Column:
        kinds = (("num", self.num, "double"), ("str", self.str, "string"), ("bool", self.bool, "boolean"), ("err", self.err, "string"))
        return F.struct(self.tag.alias("tag"), *[(F.lit(None).cast(k) if c is None else c).alias(n) for n, c, k in kinds])


def column(df: DataFrame, name: str) -> Col:
    """A table column as values; dates and timestamps are serial numbers of the 1900 system."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return Col(num=c.cast("double"))
    if isinstance(kind, T.BooleanType):
        return Col(bool=c)
    if isinstance(kind, T.DateType):
        return Col(num=F.datediff(c, F.lit("1899-12-30").cast("date")).cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Col(num=F.unix_micros(c.cast("timestamp")) / F.lit(86_400_000_000) + 25569.0)
    if isinstance(kind, T.StructType) and {"num", "str", "bool", "err"} <= set(kind.names):
        return Col(c["num"], c["str"], c["bool"], c["err"])
    return Col(str=c.cast("string"))


def first_error(*errors: Column | None) -> Column | None:
    known = [e for e in errors if e is not None]
    return F.coalesce(*known) if known else None


def unless(err: Column | None, value: Column) -> Column:
    return value if err is None else F.when(err.isNull(), value)


def to_number(c: Col) -> Col:
    parts, err = [], c.err
    if c.num is not None:
        parts.append(c.num)
    if c.bool is not None:
        parts.append(c.bool.cast("int").cast("double"))
    if c.str is not None:
        parsed = text_number(c.str)
        parts.append(parsed)
        err = first_error(err, F.when(c.str.isNotNull() & parsed.isNull(), "#VALUE!"))
    return Col(num=unless(err, F.coalesce(*parts, F.lit(0.0))), err=err)


def to_logical(c: Col) -> Col:
    parts, err = [], c.err
    if c.bool is not None:
        parts.append(c.bool)
    if c.num is not None:
        parts.append(c.num != 0)
    if c.str is not None:
        word = F.upper(c.str)
        parts.append(F.when(word == "TRUE", True).when(word == "FALSE", False))
        err = first_error(err, F.when(c.str.isNotNull() & ~word.isin("TRUE", "FALSE"), "#VALUE!"))
    return Col(bool=unless(err, F.coalesce(*parts, F.lit(False))), err=err)


def finite(value: Column, err: Column | None) -> Col:
    """A number, or #NUM! where it isn't finite; no negative zero."""
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    err = first_error(err, F.when(bad, "#NUM!"))
    return Col(num=F.when(err.isNull(), value + F.lit(0.0)), err=err)


def arithmetic(op: str, a: Col, b: Col) -> Col:
    x, y = to_number(a), to_number(b)
    err = first_error(a.err, b.err, x.err, y.err)
    if op == "/":
        err = first_error(err, F.when(y.num == 0, "#DIV/0!"))
        return finite(F.try_divide(x.num, y.num), err)
    value = {"+": lambda: x.num + y.num, "-": lambda: x.num - y.num, "*": lambda: x.num * y.num, "^": lambda: F.pow(x.num, y.num)}[op]()
    return finite(value, err)


def comparison(op: str, a: Col, b: Col) -> Col:
    apply = lambda x, y: {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    err = first_error(a.err, b.err)
    only = lambda c, f: getattr(c, f) is not None and all(getattr(c, o) is None for o in ("num", "str", "bool") if o != f)
    by_text = apply(natural_key(a.text), natural_key(b.text))
    value = by_text
    if a.bool is not None and b.bool is not None:
        value = F.when(a.bool.isNotNull() & b.bool.isNotNull(), apply(a.bool, b.bool)).otherwise(value)
    if a.num is not None and b.num is not None:
        value = F.when(a.num.isNotNull() & b.num.isNotNull(), apply(a.num, b.num)).otherwise(value if not (only(a, "num") and only(b, "num")) else by_text)
    return Col(bool=unless(err, value), err=err)


def choose(c: Column, err: Column | None, a: Col, b: Col) -> Col:
    def field(x, y):
        if x is None and y is None:
            return None
        out = F.when(c, x) if x is not None else None
        if y is not None:
            out = F.when(~c, y) if out is None else out.when(~c, y)
        return out if err is None else F.when(err.isNull(), out)

    picked = field(a.err, b.err)
    return Col(field(a.num, b.num), field(a.str, b.str), field(a.bool, b.bool), first_error(err, picked))


@dataclass(frozen=True)
class Part:
    """What one argument brings to an aggregate: numbers (how many, sum, least, most), truth values (whether all, any), the first error."""

    n: Column | None = None
    sum: Column | None = None
    min: Column | None = None
    max: Column | None = None
    all: Column | None = None
    any: Column | None = None
    err: Column | None = None


def of_all(pick, values: list[Column]) -> Column:
    return pick(*values) if len(values) > 1 else values[0]


def truth(c: Col) -> Column | None:
    known = [x for x in (c.bool, None if c.num is None else c.num != 0) if x is not None]
    return F.coalesce(*known) if known else None


def of_value(a: Col, ranged: bool) -> Part:
    """The part of a single value; texts and truth values are numbers only outside ranges."""
    found = [] if a.num is None else [a.num]
    if not ranged:
        found += [] if a.bool is None else [a.bool.cast("int").cast("double")]
        found += [] if a.str is None else [text_number(a.str)]
    x, flag = F.coalesce(*found) if found else None, truth(a)
    return Part(None if x is None else x.isNotNull().cast("long"), x, x, x, flag, flag, a.err)


def of_cells(cells: list[Col], order: Column) -> Part:
    """The part of many rows of cells, as aggregate functions; errors come in the order of rows, then of columns."""
    numbers, flags = [c.num for c in cells if c.num is not None], [f for f in map(truth, cells) if f is not None]
    err = first_error(*[c.err for c in cells])
    total = lambda f: reduce(lambda a, b: a + b, [F.coalesce(f(x), F.lit(0)) for x in numbers]) if numbers else None
    best = lambda pick, f, values: of_all(pick, [f(x) for x in values]) if values else None
    return Part(
        total(F.count),
        total(F.sum),
        best(F.least, F.min, numbers),
        best(F.greatest, F.max, numbers),
        best(F.least, F.min, flags),
        best(F.greatest, F.max, flags),
        None if err is None else F.min_by(F.when(err.isNotNull(), err), F.when(err.isNotNull(), order)),
    )


def combine(name: str, parts: list[Part]) -> Col:
    err = first_error(*[p.err for p in parts])
    if name in ("AND", "OR"):
        flags = [f for f in ((p.all if name == "AND" else p.any) for p in parts) if f is not None]
        if not flags:
            return Col(err=first_error(err, F.lit("#VALUE!")))
        value = of_all(F.least if name == "AND" else F.greatest, flags)
        err = first_error(err, F.when(value.isNull(), "#VALUE!"))
        return Col(bool=F.when(err.isNull(), value), err=err)
    numbers = [p for p in parts if p.n is not None]
    count, total = F.lit(0).cast("long"), F.lit(0.0)
    for p in numbers:
        count, total = count + F.coalesce(p.n, F.lit(0)), total + F.coalesce(p.sum, F.lit(0.0))
    if name == "COUNT":
        return Col(num=unless(err, count.cast("double")), err=err)
    if name == "SUM":
        return finite(total, err)
    if name == "AVERAGE":
        return finite(F.try_divide(total, count), first_error(err, F.when(count == 0, "#DIV/0!")))
    best = of_all(F.least, [p.min for p in numbers]) if name == "MIN" and numbers else of_all(F.greatest, [p.max for p in numbers]) if numbers else F.lit(None).cast("double")
    return Col(num=unless(err, F.coalesce(best, F.lit(0.0))), err=err)


class Compiler:
    """columns: the table's columns in sheet order; a reference to a column in the formula's own row (base) is that column.
    known: what other references and ranges are, by node."""

    def __init__(self, columns: list[Col], known: dict | None = None, base: int = 2):
        self.columns, self.known, self.base = columns, known or {}, base

    def at(self, col: int) -> Col:
        return self.columns[col - 1] if col <= len(self.columns) else Col()

    def own(self, x) -> bool:
        """Whether a reference or range stays in the formula's row, or out of the table."""
        box = x.box if isinstance(x, Range) else Box(x.at, x.at)
        fixed = any(x.fixed) if isinstance(x, Range) else x.fixed
        return x.sheet is None and (box.first.col > len(self.columns) or box.first.row == box.last.row == self.base and not fixed)

    def __call__(self, x) -> Col:
        if id(x) in self.known:
            return self.known[id(x)]
        if isinstance(x, Literal):
            return {"number": lambda v: Col(num=F.lit(float(v))), "string": lambda v: Col(str=F.lit(v)), "boolean": lambda v: Col(bool=F.lit(v)), "error": lambda v: Col(err=F.lit(v))}[x.kind](x.value)
        if isinstance(x, Ref):
            if x.sheet is not None:
                return Col(err=F.lit("#REF!"))
            if not self.own(x):
                raise SheetError("unsupported-reference", f"row {x.at.row} is not the formula's row {self.base}: with_formula resolves it")
            return self.at(x.at.col)
        if isinstance(x, Range):
            return Col(err=F.lit("#VALUE!"))
        if isinstance(x, (Prefix, Percent)):
            v = to_number(self(x.x))
            value = F.try_divide(v.num, F.lit(100.0)) if isinstance(x, Percent) else -v.num if x.op == "-" else v.num
            return finite(value, v.err)
        if isinstance(x, Binary):
            a, b = self(x.left), self(x.right)
            if x.op == "&":
                err = first_error(a.err, b.err)
                return Col(str=unless(err, F.concat(a.text, b.text)), err=err)
            return arithmetic(x.op, a, b) if x.op in "+-*/^" else comparison(x.op, a, b)
        return self.call(x)

    def parts(self, x: Call) -> list[Part]:
        out = []
        for a in x.args:
            if not isinstance(a, Range):
                out.append(of_value(self(a), False))
            elif id(a) in self.known:
                out.append(self.known[id(a)])
            elif a.sheet is not None:
                out.append(Part(err=F.lit("#REF!")))
            elif self.own(a):
                out += [of_value(self.at(col), True) for col in range(a.box.first.col, a.box.last.col + 1)]
            else:
                raise SheetError("unsupported-range", "the range has other rows than the formula's: with_formula or summarise resolve it")
        return out

    def call(self, x: Call) -> Col:
        if x.name not in FUNCTIONS:
            raise SheetError("unsupported-function", f"{x.name} is not supported")
        if x.name == "IF":
            if not 2 <= len(x.args) <= 3:
                return Col(err=F.lit("#VALUE!"))
            c = to_logical(self(x.args[0]))
            return choose(c.bool, c.err, self(x.args[1]), self(x.args[2]) if len(x.args) == 3 else Col(bool=F.lit(False)))
        if x.name == "NOT":
            if len(x.args) != 1 or isinstance(x.args[0], Range):
                return Col(err=first_error(*[p.err for p in self.parts(x)], F.lit("#VALUE!")))
            c = to_logical(self(x.args[0]))
            return Col(bool=~c.bool, err=c.err)
        return combine(x.name, self.parts(x))


def fill_down(df: DataFrame, formula: str, columns: list[str], base: int = 2) -> Col:
    """A formula written for body row base, as columns over all rows of df. It may refer to its own row only; another sheet is #REF!."""
    return Compiler([column(df, c) for c in columns], base=base)(parse(formula))


@dataclass(frozen=True)
class Sheet:
    """A table that formulas may refer to: its columns in sheet order, and the column that holds each row's number in the sheet (unique)."""

    df: DataFrame
    columns: tuple[str, ...]
    row: str

    def cells(self, box: Box) -> list[Col]:
        return [column(self.df, c) for c in self.columns[box.first.col - 1 : box.last.col]]

    def rows(self, first: int, last: int) -> DataFrame:
        return self.df if last == LAST_ROW and first <= 1 else self.df.where(F.col(self.row).between(first, last))


def fields(value, of: Column):
    """value (a Col or Part) with each field that it has taken from a struct."""
    return replace(value, **{k: of[k] for k, v in vars(value).items() if v is not None})


def packed(value) -> Column:
    found = [v.alias(k) for k, v in vars(value).items() if v is not None]
    return F.struct(*found, F.lit(True).alias("there"))


def with_formula(df: DataFrame, name: str, formula: str, columns: list[str], row: str | None = None, base: int = 2, sheets: dict[str, Sheet] | None = None) -> DataFrame:
    """df with the formula's values as a struct column of tag, num, str, bool and err.

    The formula is written for sheet row base. row names the column with each row's number in the sheet; with it, the formula may refer to other rows (B1), fixed
    rows (B$1), several rows (B2:B9, B$2:B$9, or to the last row of the grid), and the same of other sheets. Rows that aren't there are blank, unknown sheets #REF!.
    A row meets other rows by an equality join on row numbers; fixed ones are scalar subqueries."""
    sheets = {k.lower(): v for k, v in (sheets or {}).items()}
    tree = parse(formula)
    own = Compiler([column(df, c) for c in columns], base=base)
    here = Sheet(df, tuple(columns), row) if row else None
    out, known = df, {}
    for i, x in enumerate(references(tree)):
        sheet = here if x.sheet is None else sheets.get(x.sheet.lower())
        if own.own(x) or x.sheet is not None and sheet is None or isinstance(x, Range) and x.box.first.col > len(sheet.columns if sheet else columns):
            continue
        if sheet is None or row is None:
            raise SheetError("unsupported-reference", "references to other rows need the column with the row numbers")
        box = x.box if isinstance(x, Range) else Box(x.at, x.at)
        if box.first.col > len(sheet.columns):
            known[id(x)] = Col()
            continue
        cells = sheet.cells(box)
        several = isinstance(x, Range)
        value = of_cells(cells, F.col(sheet.row)) if several else cells[0]
        fixed = x.fixed if several else (x.fixed, x.fixed)
        if fixed == (True, True) or several and box.last.row == LAST_ROW:
            one = sheet.rows(box.first.row, box.last.row).agg((packed(value) if several else F.first(packed(value))).alias("v"))
            known[id(x)] = fields(value, one.scalar())
            continue
        if fixed[0] != fixed[1]:
            raise SheetError("unsupported-range", "one end of the range is fixed and the other one is not")
        key, found = f"__row{i}", f"__found{i}"
        if several:
            # each row of the sheet is part of the ranges of as many formulas as a range has rows
            wanted = F.explode(F.sequence(F.col(sheet.row) - (box.last.row - base), F.col(sheet.row) - (box.first.row - base)))
            spread = sheet.df.withColumn(key, wanted)
            near = spread.groupBy(key).agg(packed(value).alias(found))
        else:
            near = sheet.df.select((F.col(sheet.row) - (box.first.row - base)).alias(key), packed(value).alias(found))
        out = out.join(near, out[row] == near[key], "left").drop(key)
        known[id(x)] = fields(value, F.col(found))
    value = Compiler([column(out, c) for c in columns], known, base)(tree)
    return out.withColumn(name, value.struct()).select(*df.columns, name)


def whole_columns(x) -> bool:
    return isinstance(x, Range) and x.sheet is None and x.box.last.row == LAST_ROW


def summarise(df: DataFrame, formulas: dict[str, str], columns: list[str], order: list[str]) -> DataFrame:
    """One row: each formula over whole columns (as D2:D1048576), all in a single aggregation. order tells which error is the first."""
    cells = [column(df, c) for c in columns]
    trees = {name: parse(f) for name, f in formulas.items()}
    key = F.struct(*[F.col(f"`{o}`") for o in order])
    values, known = [], {}
    for x in (x for t in trees.values() for x in references(t)):
        if whole_columns(x):
            part = of_cells(cells[x.box.first.col - 1 : x.box.last.col], key)
            names = {}
            for k, v in vars(part).items():
                if v is not None:
                    names[k] = f"_{len(values)}"
                    values.append(v.alias(names[k]))
            known[id(x)] = Part(**{k: F.col(n) for k, n in names.items()})
        elif x.sheet is None:
            raise SheetError("unsupported-range", "references of a summary must be whole columns")
    compiler = Compiler([], known)
    # a summary without any number, truth value or error still has its one row
    return df.agg(F.lit(0).alias("_"), *values).select(*[compiler(t).struct().alias(name) for name, t in trees.items()])
