import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgrid.errors import FormulaParseError, SheetError
from quillgrid.functions import scalars
from quillgrid.functions.scalars import Value
from quillgrid.functions.text import number_text as number_text_column
from quillgrid.functions.text import text_number as text_number_column
from quillgrid.functions.text import natural_key
from quillgrid.plans.compile import Sheet, fill_down, summarise, with_formula
from quillgrid.plans.formula import parse, references
from quillgrid.plans.interpret import Cell, Limits, calculate

N = lambda x: Cell(Value("number", float(x)))


def one(formula, **cells):
    table = {(1, 1, 1): Cell(formula=formula)} | {(1, int(k[1:]), ord(k[0]) - 64): v for k, v in cells.items()}
    return calculate(table, {"S": 1})


def value(formula, **cells):
    return one(formula, **cells).values.get((1, 1, 1))


@pytest.mark.parametrize(
    ("formula", "want"),
    [
        ("1/0", Value("error", "#DIV/0!")), ("AVERAGE(1,2,3)", Value("number", 2.0)), ("AND(1,TRUE,NOT(FALSE))", Value("boolean", True)), ('"2"+3&"!"', Value("string", "5!")),
        ('MIN(4,2,9)+MAX(4,2,9)+COUNT(4,TRUE,"x")', Value("number", 13.0)), ("IF(TRUE,1,MISSING())", Value("number", 1.0)), ("-2^2", Value("number", 4.0)), ("2^3^2", Value("number", 64.0)),
        ("2^3%", Value("number", 2**0.03)), ('1="1"', Value("boolean", True)), ('"a2"<"a10"', Value("boolean", True)), ('"a"="A"', Value("boolean", True)), ('"é"="E"', Value("boolean", True)), ('B9=""', Value("boolean", True)), ("B9=0", Value("boolean", False)),
        ('AND("TRUE")', Value("error", "#VALUE!")), ('IF("true",1)', Value("number", 1.0)), ("IF(FALSE,1)", Value("boolean", False)), ("AVERAGE(B1:B2)", Value("error", "#DIV/0!")), ("MIN(B1:B2)", Value("number", 0.0)),
        ("B1:B2", Value("error", "#VALUE!")), ("Nowhere!A1", Value("error", "#REF!")), ("#N/A+1/0", Value("error", "#N/A")), ("10^400", Value("error", "#NUM!")), ("B9", Value("blank")), ("(0-8)^0.5", Value("error", "#NUM!")), ("NOT(1,2)", Value("error", "#VALUE!")), ("NOT(#N/A,1)", Value("error", "#N/A")), ("1-2-3", Value("number", -4.0)), ("2+3*4^2-1", Value("number", 49.0)), ("--3%", Value("number", 0.03)), ('1&2+3="15"', Value("boolean", True)),
    ],
)
def test_values(formula, want):
    assert value(formula) == want


def test_scalar_and_range_arguments():
    five = Cell(Value("string", "5"))
    assert value("SUM(B1)", B1=five) == Value("number", 5.0)
    assert value("SUM(B1:B1)", B1=five) == Value("number", 0.0)
    assert value("COUNT(B1:B2)", B1=N(1), B2=Cell(Value("error", "#N/A"))) == Value("error", "#N/A")


def test_cycles_fallback_and_limits():
    c = calculate({(1, 1, 1): Cell(formula="A2+1"), (1, 2, 1): Cell(formula="A1+1"), (1, 3, 1): Cell(formula="A1*2")}, {"S": 1})
    assert c.values == {} and set(c.diagnostics.values()) == {"circular-reference"} and len(c.diagnostics) == 3
    c = calculate({(1, 1, 1): Cell(Value("number", 42.0), "XLOOKUP(B1)"), (1, 2, 1): Cell(formula="A1+1")}, {"S": 1})
    assert (1, 1, 1) not in c.values and c.values[1, 2, 1] == Value("number", 43.0) and c.diagnostics == {(1, 1, 1): "unsupported-function"}
    c = calculate({(1, 1, 1): Cell(formula="SUM(A2:XFD1048576)")}, {"S": 1}, limits=Limits(range_cells=20))
    assert c.diagnostics == {(1, 1, 1): "evaluation-limit"}
    c = calculate({(1, i, 1): Cell(formula=f"A{i + 1}+1") for i in range(1, 1500)}, {"S": 1})
    assert "evaluation-limit" in c.diagnostics.values()
    c = calculate({(1, 1, 1): Cell(formula="1"), (1, 2, 1): Cell(formula="1")}, {"S": 1}, 1, Limits(formula_cells=1))
    assert c.diagnostics == {(1, 0, 0): "evaluation-limit"}


def test_dependencies_list_untaken_branches_once():
    c = one("IF(TRUE,B1,SUM(B1:B3))")
    assert c.dependencies[1, 1, 1] == [(1, 1, 2), (1, 2, 2), (1, 3, 2)]
    assert len(references(parse("IF(A1,B1,C1:C3)"))) == 3


@pytest.mark.parametrize("text", ["=SUM(A1:A2)", "SUM(A1:A2", "A1:", "[Book.xlsx]Sheet1!A1", "A0+1", "MysteryName", "XFE1", "A1048577", "1+", "'S'A1", '"open', "1e999"])
def test_parse_errors(text):
    with pytest.raises(FormulaParseError):
        parse(text)


@settings(max_examples=200)
@given(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6))
def test_addition(a, b):
    assert value(f"({scalars.number_text(a)})+({scalars.number_text(b)})").value == a + b


SCALARS = ["1", "-2.5", "0", '"7"', '"x"', '"TRUE"', "TRUE", "FALSE", "I9", "#N/A", '""', "B2", "C2", "D2"]


def test_compiler_against_interpreter(spark):
    """Both back ends give the same value for formulas over a row of mixed columns."""
    import random

    rng = random.Random(11)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(SCALARS)
        a, b, c = (tree(depth - 1) for _ in range(3))
        return rng.choice([f"({a}+{b})", f"({a}/{b})", f"({a}&{b})", f"({a}={b})", f"({a}<{b})", f"IF({a},{b},{c})", f"NOT({a})", f"AND({a},{b})", f"SUM({a},{b},{c})", f"COUNT({a},{b})", f"MAX({a},{b})", f"-{a}", f"{a}%", f"AVERAGE({a},{b})", f"({a}*{b})"])

    rows = [(1, 4.0, "abc", True), (2, None, "12", False), (3, -1.5, None, None)]
    df = spark.createDataFrame(rows, "k int, n double, s string, b boolean")
    formulas = [tree(2) for _ in range(30)]
    got = df.select("k", *[fill_down(df, f, ["k", "n", "s", "b"]).struct().alias(f"f{i}") for i, f in enumerate(formulas)]).collect()
    for r in got:
        cells = {(1, 2, i): Cell(Value("blank") if v is None else Value("boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "number", v)) for i, v in enumerate(rows[r["k"] - 1], 1)}
        for i, f in enumerate(formulas):
            c = calculate(cells | {(1, 2, 9): Cell(formula=f)}, {"S": 1})
            want, have = c.values[1, 2, 9], r[f"f{i}"]
            field = {"number": have.num, "string": have.str, "boolean": have.bool, "error": have.err, "blank": None}[have.tag]
            assert have.tag == want.tag and (field == want.value or want.tag == "number" and abs(field - want.value) < 1e-9), (f, r["k"], have, want)


def test_number_text_and_back(spark):
    values = [0.0, 5.0, 12345678.0, 0.1, 1e-6, 1.5e-7, 1e21, 1.25e22, 123456789012345680000.0, -2.5e-9, 1e15, 1.7976931348623157e308, 9007199254740993.5, 0.000123]
    texts = ["0", "5", "12345678", "0.1", "0.000001", "1.5e-7", "1e+21", "1.25e+22", "123456789012345680000", "-2.5e-9", "1000000000000000", "1.7976931348623157e+308", "9007199254740994", "0.000123"]
    df = spark.createDataFrame([(None,)], "x double")
    assert df.select(number_text_column(df.x)).first()[0] is None
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [scalars.number_text(v) for v in values] == texts
    assert [r[0] for r in df.select(number_text_column(df.x)).collect()] == texts
    raw = [" 12 ", "1e3", "0x1F", "0b11", "0o17", "5d", "Infinity", "", "  ", ".5", "5.", "1e999", "-0x1", "abc", "+3"]
    want = [scalars.text_number(t) for t in raw]
    assert want == [12.0, 1000.0, 31.0, 3.0, 15.0, None, None, None, None, 0.5, 5.0, None, None, None, 3.0]
    df = spark.createDataFrame([(t,) for t in raw], "t string")
    assert [r[0] for r in df.select(text_number_column(df.t)).collect()] == want


def test_summaries_combine(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "k int, v double")
    row = summarise(df, {"a": "SUM(B2:B1048576)/COUNT(B2:B1048576)&\"x\"", "b": "AVERAGE(A2:B1048576)"}, ["k", "v"], ["k"]).first()
    assert row.a.str == "3x" and row.b.num == 12 / 5


def test_other_rows_and_sheets(spark):
    """Formulas that leave their row give what the interpreter gives cell by cell."""
    first, other = [10.0, 20.0, None, 5.0, -3.0], [7.0, 8.0, 9.0]
    df = spark.createDataFrame([(i + 2, i, v, "t") for i, v in enumerate(first)], "at int, A int, B double, C string")
    b = spark.createDataFrame([(i + 1, v) for i, v in enumerate(other)], "r int, A double")
    formulas = ["Other!A2*2", "Nope!B2", "$B$1*1", "$B$3*B2", "SUM(B2:B9)", "B3-B1", "COUNT(B1:C3)", "SUM($B$2:$B$4)+B2", "MAX(other!A1:A2)", "AVERAGE(B2:B1048576)", "IF(B2>B3,B3,B2)", "MIN(B$2:B$3,Other!A2,4)", "Z9+1", "NOT(B1)", "AND(B2:B3)"]
    for f in formulas:
        out = with_formula(df, "v", f, ["A", "B", "C"], "at", sheets={"Other": Sheet(b, ("A",), "r")})
        for r in out.collect():
            cells = {(1, i + 2, c): Cell(Value("blank") if v is None else Value("string" if c == 3 else "number", v)) for i, x in enumerate(first) for c, v in ((1, float(i)), (2, x), (3, "t"))}
            cells |= {(2, i + 1, 1): Cell(Value("number", v)) for i, v in enumerate(other)}
            moved = moved_down(f, r["at"] - 2)
            want = calculate(cells | {(1, r["at"], 9): Cell(formula=moved)}, {"S": 1, "Other": 2}, limits=Limits(range_cells=10**7, operations=10**8)).values[1, r["at"], 9]
            have = {"number": r.v.num, "string": r.v.str, "boolean": r.v.bool, "error": r.v.err, "blank": None}[r.v.tag]
            assert (r.v.tag, have) == (want.tag, want.value), (f, moved, r["at"])


def moved_down(formula, n):
    import re

    return re.sub(r"(?<![A-Za-z$])(\$?[A-Z])(\$?)([0-9]+)(?![0-9])", lambda m: m[0] if m[2] or m[3] == "1048576" or formula.startswith("AVERAGE") else f"{m[1]}{int(m[3]) + n}" if int(m[3]) + n > 0 else m[0], formula)


def test_references_that_need_more(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "k int, v double, t string")
    for f in ("B3", "B$2", "SUM(B2:B9)", "SUM(B2:B1048576)"):
        with pytest.raises(SheetError):
            fill_down(df, f, ["k", "v", "t"])
    with pytest.raises(SheetError):
        with_formula(df, "x", "SUM(B2:B$9)", ["k", "v", "t"], "k")
    assert summarise(df, {"n": "COUNT(C2:C1048576)", "s": "SUM(C2:C1048576)", "a": "AVERAGE(C2:C1048576,3)", "x": "MAX(1,2)"}, ["k", "v", "t"], ["k"]).first()["n"].num == 0
    with pytest.raises(FormulaParseError):
        parse("(" * 4000 + "1" + ")" * 4000)


def test_long_numbers_in_text(spark):
    texts = ["a123456789012345678901", "a12345678901234567890199", "a99", "a0100"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.orderBy(natural_key(df.t)).collect()] == ["a99", "a0100", texts[0], texts[1]]
