"""Display formats: a plan for each format code, applied to Python values or to columns."""

from __future__ import annotations

import datetime
import math
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.scalars import Value, number_text
from quillgrid.functions.text import number_text as number_text_column

#: Fixed values of the format: built-in format codes by id.
BUILT_IN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 49: "@",
}
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
#: Decimal and grouping signs.
LOCALES = {"en-US": (".", ","), "de-DE": (",", "."), "fr-FR": (",", " "), "es-ES": (",", ".")}
INVALID = "########"


def sections(code: str) -> list[str]:
    """At most four sections, split at semicolons outside of quotes and brackets."""
    out, quoted, depth, i = [""], False, 0, 0
    while i < len(code):
        c = code[i]
        if c == "\\" and i + 1 < len(code):
            out[-1] += code[i : i + 2]
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "[]":
            depth += 1 if c == "[" else -1
        if c == ";" and not quoted and depth <= 0:
            out.append("")
        else:
            out[-1] += c
        i += 1
    return out[:4]


def section_of(n: int, value_sign: int) -> int:
    """Which of n sections shows a value: with two sections, zero takes the second."""
    if value_sign > 0 or n == 1:
        return 0
    return 1 if value_sign < 0 else min(2, n - 1)


def pieces(section: str) -> list[tuple[str, str]]:
    """Literals and format signs of a section; colours and conditions, padding and fill are dropped."""
    out, i = [], 0
    while i < len(section):
        c = section[i]
        if c == '"':
            j = section.find('"', i + 1)
            j = len(section) if j < 0 else j
            out.append(("literal", section[i + 1 : j]))
            i = j + 1
        elif c == "\\":
            out.append(("literal", section[i + 1 : i + 2]))
            i += 2
        elif c in "_*":
            i += 2
        elif c == "[":
            j = section.find("]", i)
            j = len(section) - 1 if j < 0 else j
            i = j + 1
        else:
            out.append(("sign", c))
            i += 1
    return out


def is_date(section: str) -> bool:
    signs = "".join(s for kind, s in pieces(section) if kind == "sign")
    return not re.search(r"[0#?]", re.sub(r"\.0+", "", signs)) and bool(re.search(r"[ydhs]", signs, re.I)) and signs.lower() != "general"


@dataclass(frozen=True)
class Numeric:
    """A decimal, scientific or fraction section."""

    kind: str
    prefix: str
    suffix: str
    whole: int
    least: int
    most: int
    grouped: bool
    percent: int
    thousands: int
    exponent: int = 0
    digits: int = 1


def numeric(section: str) -> Numeric | None:
    p = pieces(section)
    first = next((i for i, (kind, s) in enumerate(p) if kind == "sign" and s in "0#?."), None)
    percent = sum(kind == "sign" and s == "%" for kind, s in p)
    text = lambda part: "".join(s for _, s in part)
    if first is None:
        return None
    last = max(i for i, (kind, s) in enumerate(p) if kind == "sign" and s in "0#?.,")
    body = "".join(s for _, s in p[first : last + 1])
    prefix, suffix = text(p[:first]), text(p[last + 1 :])
    if m := re.match(r"([#0?,]*)\.?([0#?]*)[eE][+-]?(0+)", body):
        return Numeric("scientific", prefix, suffix, max(1, m[1].count("0")), m[2].count("0"), len(m[2]), False, percent, 0, len(m[3]))
    if "/" in body:
        return Numeric("fraction", prefix, suffix, 0, 0, 0, False, percent, 0, 0, len(re.search(r"/\s*([0#?0-9]*)", body)[1]) or 1)
    thousands = len(body) - len(body.rstrip(","))
    core = body.rstrip(",")
    left, _, right = core.partition(".")
    return Numeric("decimal", prefix, suffix, left.count("0"), right.count("0"), sum(c in "0#?" for c in right), "," in left, percent, thousands)


def half_up(x: float, places: int) -> Decimal:
    return Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)


def decimal_text(x: float, n: Numeric, locale: str) -> str:
    point, group = LOCALES[locale]
    text = format(half_up(abs(x) * 100**n.percent / 1000**n.thousands, n.most), "f")
    whole, _, part = text.partition(".")
    while len(part) > n.least and part.endswith("0"):
        part = part[:-1]
    whole = ("" if whole == "0" and n.whole == 0 and part else whole).zfill(n.whole)
    if n.grouped:
        whole = re.sub(r"(?<=\d)(?=(\d{3})+$)", group, whole)
    return whole + (point + part if part else "")


def scientific_text(x: float, n: Numeric, locale: str) -> str:
    e = 0 if x == 0 else math.floor(math.log10(abs(x)))
    mantissa = half_up(abs(x) / 10.0**e if abs(e) < 300 else abs(x) / 10.0 ** (e // 2) / 10.0 ** (e - e // 2), n.most)
    if mantissa >= 10:
        mantissa, e = half_up(1, n.most), e + 1
    return f"{format(mantissa, 'f').replace('.', LOCALES[locale][0])}E{'-' if e < 0 else '+'}{str(abs(e)).zfill(n.exponent)}"


def fraction_text(x: float, n: Numeric) -> str:
    whole, rest = divmod(abs(x), 1)
    error, den = min((abs(rest - round_half(rest * d) / d), d) for d in range(1, 10**n.digits))
    num = round_half(rest * den)
    g = math.gcd(num, den) or 1
    num, den = num // g, den // g
    if num == 0:
        return str(int(whole))
    return f"{int(whole)} {num}/{den}" if whole else f"{num}/{den}"


def round_half(x: float) -> int:
    return math.floor(x + 0.5)


def date_tokens(section: str) -> list[tuple[str, str]]:
    """Parts of a date section; m is a minute after h or before s."""
    out: list[tuple[str, str]] = []
    signs = pieces(section)
    i = 0
    while i < len(signs):
        kind, s = signs[i]
        rest = "".join(x if k == "sign" else "\0" for k, x in signs[i:])
        if kind == "literal":
            out.append(("literal", s))
            i += 1
        elif m := re.match(r"AM/PM|A/P", rest, re.I):
            out.append(("ampm", m[0]))
            i += len(m[0])
        elif m := re.match(r"\.0+", rest):
            out.append(("fraction", m[0]))
            i += len(m[0])
        elif m := re.match(r"([ymdhs])\1*", rest, re.I):
            out.append((m[0][0].lower(), m[0].lower()))
            i += len(m[0])
        else:
            out.append(("literal", s))
            i += 1
    fields = [j for j, (k, _) in enumerate(out) if k in "ymdhs"]
    for a, j in enumerate(fields):
        if out[j][0] == "m" and (a and out[fields[a - 1]][0] == "h" or a + 1 < len(fields) and out[fields[a + 1]][0] == "s"):
            out[j] = ("minute", out[j][1])
    return out


def date_text(serial: float, section: str, date1904: bool = False) -> str:
    if serial < 0 or serial >= 2_958_466:
        return INVALID
    tokens = date_tokens(section)
    places = max([len(t) - 1 for k, t in tokens if k == "fraction"], default=0)
    unit = 10**places
    ticks = round_half(serial * 86_400 * unit)
    day, within = divmod(ticks, 86_400 * unit)
    seconds, part = divmod(within, unit)
    if date1904:
        d = datetime.date(1904, 1, 1) + datetime.timedelta(days=day)
        y, mo, da, wd = d.year, d.month, d.day, d.weekday()
    elif day == 60:  # the day that never was
        y, mo, da, wd = 1900, 2, 29, 2
    elif day == 0:
        y, mo, da, wd = 1900, 1, 0, 5
    else:
        d = datetime.date(1899, 12, 31 if day < 60 else 30) + datetime.timedelta(days=day)
        y, mo, da, wd = d.year, d.month, d.day, d.weekday()
    h, mi, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    twelve = any(k == "ampm" for k, _ in tokens)
    out = ""
    for k, t in tokens:
        n = len(t)
        if k == "literal":
            out += t
        elif k == "y":
            out += f"{y % 100:02d}" if n <= 2 else f"{y:04d}"
        elif k == "m":
            out += str(mo).zfill(n) if n <= 2 else MONTHS[mo - 1][:3] if n == 3 else MONTHS[mo - 1][0] if n == 5 else MONTHS[mo - 1]
        elif k == "d":
            out += str(da).zfill(n) if n <= 2 else DAYS[wd][:3] if n == 3 else DAYS[wd]
        elif k == "h":
            out += str((h % 12 or 12) if twelve else h).zfill(min(n, 2))
        elif k == "minute":
            out += str(mi).zfill(min(n, 2))
        elif k == "s":
            out += str(s).zfill(min(n, 2))
        elif k == "fraction":
            out += "." + str(part).zfill(n - 1)
        else:
            out += ("AM" if h < 12 else "PM") if n > 3 else ("A" if h < 12 else "P")
    return out


def format_value(v: Value, code: str | int = "General", locale: str = "en-US", date1904: bool = False) -> str:
    """How a cell shows its value. Only numbers go through the format."""
    if v.tag == "blank":
        return ""
    if v.tag == "boolean":
        return "TRUE" if v.value else "FALSE"
    if v.tag != "number":
        return str(v.value)
    code = BUILT_IN.get(code, "General") if isinstance(code, int) else code
    x = v.value
    if code.lower() == "general" or code == "@":
        return number_text(x).replace(".", LOCALES[locale][0])
    parts = sections(code)
    k = section_of(len(parts), (x > 0) - (x < 0))
    section = parts[k]
    if is_date(section):
        return date_text(x, section, date1904)
    n = numeric(section)
    if n is None:
        return "".join(s for _, s in pieces(section))
    text = fraction_text(x, n) if n.kind == "fraction" else scientific_text(x, n, locale) if n.kind == "scientific" else decimal_text(x, n, locale)
    sign = "-" if x < 0 and k == 0 else ""
    return n.prefix + sign + text + n.suffix if not n.prefix else sign + n.prefix + text + n.suffix


def _decimal_column(x: Column, n: Numeric, locale: str) -> Column:
    point, group = LOCALES[locale]
    scaled = F.round(F.abs(x) * float(100**n.percent) / float(1000**n.thousands), n.most)
    text = F.call_function("format_number", scaled, F.lit(("#,##0" if n.grouped else "#0") + ("." + "0" * n.most if n.most else "")))
    if n.most > n.least:
        text = F.regexp_replace(text, r"(\.[0-9]{%d}[0-9]*?)0+$" % n.least, "$1")
        text = F.regexp_replace(text, r"\.$", "")
    if n.whole == 0 and n.most:
        text = F.regexp_replace(text, r"^0(?=\.)", "")
    if n.whole > 1:
        whole, part = F.substring_index(text, ".", 1), F.regexp_extract(text, r"(\..*)$", 1)
        text = F.concat(F.when(F.length(whole) < n.whole, F.lpad(whole, n.whole, "0")).otherwise(whole), part)
    return text if (point, group) == (".", ",") else F.translate(text, ".,", point + group)


def _let(x: Column, f) -> Column:
    """f of a value that is worked out once."""
    return F.transform(F.array(x), f)[0]


def _above(a: Column, digits: Column, power: Column) -> Column:
    """Over 0, 0 or below as a, the double nearest to digits * 10 ** power, is larger than that, equal or smaller: the product is exact in two doubles up to 10 ** 22; null beyond."""
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)

    def rest(s: Column) -> Column:
        xl, tl = s["x"] - s["xh"], s["t"] - s["th"]
        low = ((s["xh"] * s["th"] - s["x"] * s["t"]) + s["xh"] * tl + xl * s["th"]) + xl * tl
        return (s["x"] * s["t"] - s["y"]) + low

    inverse = power < 0
    parts = F.struct(F.when(inverse, a).otherwise(digits).alias("x"), F.when(inverse, digits).otherwise(a).alias("y"), F.pow(F.lit(10.0), F.abs(power)).alias("t"))
    found = _let(parts, lambda s: _let(F.struct(s["x"].alias("x"), s["y"].alias("y"), s["t"].alias("t"), high(s["x"]).alias("xh"), high(s["t"]).alias("th")), rest))
    return F.when(F.abs(power) <= 22, F.when(inverse, found).otherwise(-found))


def _scientific_column(x: Column, n: Numeric, locale: str, ties: str) -> Column:
    a = F.abs(x)
    text = F.format_string(f"%.{n.most}e", a)
    if ties == "even":
        # format_string rounds the shortest digits up where they end in the middle; these are told by one digit more
        more = F.format_string(f"%.{n.most + 1}e", a)

        def down(s: Column) -> Column:
            above = _above(s["a"], s["digits"], s["power"])
            return _let(above, lambda v: (v < 0) | ((v == 0) & (F.floor(s["digits"] / 10) % 2 == 0)))

        parts = F.struct(a.alias("a"), F.translate(F.substring_index(more, "e", 1), ".", "").try_cast("double").alias("digits"), (F.substring_index(more, "e", -1).try_cast("int") - (n.most + 1)).alias("power"))
        middle = more.contains("5e") & (more.try_cast("double") == a)
        text = F.when(middle & _let(parts, down), F.regexp_replace(more, r"\.?5e", "e")).otherwise(text)
        return _let(F.upper(text), lambda t: _scientific_parts(t, n, locale))
    return _scientific_parts(F.upper(text), n, locale)


def _scientific_parts(text: Column, n: Numeric, locale: str) -> Column:
    mantissa, sign, digits = F.substring_index(text, "E", 1), F.regexp_extract(text, "E([+-])", 1), F.regexp_extract(text, "E[+-]0*([0-9]+)$", 1)
    digits = F.when(F.length(digits) < n.exponent, F.lpad(digits, n.exponent, "0")).otherwise(digits)
    return F.concat(F.translate(mantissa, ".", LOCALES[locale][0]), F.lit("E"), sign, digits)


def _fraction_column(x: Column, n: Numeric) -> Column:
    a = F.abs(x)
    whole = F.floor(a)
    rest = a - whole
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(10**n.digits - 1)), lambda d: F.struct(F.abs(rest - F.floor(rest * d + 0.5) / d).alias("error"), d.alias("den"))))
    den = best["den"]
    num = F.floor(rest * den + 0.5)
    # the best denominator is the smallest one, so the fraction is reduced already
    both = F.concat(num.cast("string"), F.lit("/"), den.cast("string"))
    return F.when(num == 0, whole.cast("string")).when(whole == 0, both).otherwise(F.concat(whole.cast("string"), F.lit(" "), both))


def _date_column(x: Column, section: str, date1904: bool) -> Column:
    tokens = date_tokens(section)
    places = max([len(t) - 1 for k, t in tokens if k == "fraction"], default=0)
    unit = 10**places
    ticks = F.floor(x * float(86_400 * unit) + 0.5).cast("bigint")
    day = F.floor(ticks / F.lit(86_400 * unit)).cast("int")
    seconds = F.floor((ticks % F.lit(86_400 * unit)) / unit).cast("int")
    part = (ticks % F.lit(unit)).cast("string")
    if date1904:
        date = F.date_add(F.lit("1904-01-01").cast("date"), day)
        leap, zero = F.lit(False), F.lit(False)
    else:
        date = F.date_add(F.lit("1899-12-30").cast("date"), F.when(day < 60, day + 1).otherwise(day))
        leap, zero = day == 60, day == 0
    h, mi, s = F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), seconds % 60
    two = lambda c, n: c.cast("string") if n < 2 else F.lpad(c.cast("string"), 2, "0")
    month, dom = F.when(leap, 2).when(zero, 1).otherwise(F.month(date)), F.when(leap, 29).when(zero, 0).otherwise(F.dayofmonth(date))
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))
    weekday = F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.when(leap, 3).when(zero, 6).otherwise(F.weekday(date) + 1).cast("int"))
    year = F.when(leap | zero, 1900).otherwise(F.year(date))
    twelve = any(k == "ampm" for k, _ in tokens)
    out = []
    for k, t in tokens:
        n = len(t)
        if k == "literal":
            out.append(F.lit(t))
        elif k == "y":
            out.append(F.lpad((year % 100).cast("string"), 2, "0") if n <= 2 else year.cast("string"))
        elif k == "m":
            out.append(two(month, n) if n <= 2 else F.substring(name, 1, 3) if n == 3 else F.substring(name, 1, 1) if n == 5 else name)
        elif k == "d":
            out.append(two(dom, n) if n <= 2 else F.substring(weekday, 1, 3) if n == 3 else weekday)
        elif k == "h":
            out.append(two(F.when(h % 12 == 0, 12).otherwise(h % 12) if twelve else h, n))
        elif k in ("minute", "s"):
            out.append(two(mi if k == "minute" else s, n))
        elif k == "fraction":
            out.append(F.concat(F.lit("."), F.lpad(part, n - 1, "0")))
        else:
            out.append(F.when(h < 12, "AM" if n > 3 else "A").otherwise("PM" if n > 3 else "P"))
    return F.when((x < 0) | (x >= 2_958_466), INVALID).otherwise(F.concat(*out) if len(out) > 1 else out[0])


def _section_column(x: Column, section: str, first: bool, locale: str, date1904: bool, ties: str) -> Column:
    if is_date(section):
        return _date_column(x, section, date1904)
    n = numeric(section)
    if n is None:
        return F.lit("".join(s for _, s in pieces(section)))
    text = _fraction_column(x, n) if n.kind == "fraction" else _scientific_column(x, n, locale, ties) if n.kind == "scientific" else _decimal_column(x, n, locale)
    sign = F.when(x < 0, "-").otherwise("") if first else F.lit("")
    return F.concat(sign, F.lit(n.prefix), text, F.lit(n.suffix))


def format_number_column(x: Column, code: str | int = "General", locale: str = "en-US", date1904: bool = False, ties: str = "up") -> Column:
    """The display text of a number column; blank stays empty.

    ties: scientific formats round a number whose digits end in the middle up, as cells do, or with "even" as printf does: by its exact binary value, and to an even digit where that is the middle itself."""
    code = BUILT_IN.get(code, "General") if isinstance(code, int) else code
    if code.lower() == "general" or code == "@":
        text = F.translate(number_text_column(x), ".", LOCALES[locale][0])
    else:
        parts = sections(code)
        of = lambda k: _section_column(x, parts[k], k == 0, locale, date1904, ties)
        n = len(parts)
        text = of(0) if n == 1 else F.when(x > 0, of(0)).when(x < 0, of(1)).otherwise(of(section_of(n, 0)))
    return F.when(x.isNull(), "").otherwise(text)


def display(cell, code: str | int = "General", locale: str = "en-US", date1904: bool = False) -> Column:
    """The display text of a compiled value (plans.compile.Col)."""
    parts = [F.when(c.isNotNull(), t) for c, t in (
        (cell.err, cell.err),
        (cell.num, None if cell.num is None else format_number_column(cell.num, code, locale, date1904)),
        (cell.bool, None if cell.bool is None else F.when(cell.bool, "TRUE").otherwise("FALSE")),
        (cell.str, cell.str),
    ) if c is not None]
    return F.coalesce(*parts, F.lit(""))
