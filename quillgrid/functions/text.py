"""Column functions for text rules: number text, text to number, natural order and wildcards."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of the Latin blocks and their base letters, from Unicode's decompositions.
ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WHITE = " \t\n\x0b\x0c\r\xa0﻿"


def base_letters(text: Column) -> Column:
    return F.translate(F.lower(text), "".join(ACCENTED), "".join(ACCENTED.values()))


def natural_key(text: Column) -> Column:
    """Text whose order is that of the text without case and accents, numbers by value: each has its number of digits in front."""
    count = lambda digits: F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
    pad = lambda x: F.when(x.rlike("^[0-9]"), count(F.regexp_replace(x, "^0+(?=[0-9])", ""))).otherwise(x)
    return F.array_join(F.transform(F.regexp_extract_all(base_letters(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), pad), "")


def text_number(text: Column) -> Column:
    """The number a text stands for; null where it is empty, none, or not finite."""
    t = F.btrim(text, F.lit(WHITE))
    decimal = F.when(t.rlike(DECIMAL), t.try_cast("double"))
    radix = F.coalesce(*[F.when(t.rlike(f"^0[{p}{p.upper()}][{d}]+$"), F.conv(F.substring(t, 3, 60), b, 10).try_cast("double")) for p, d, b in (("x", "0-9a-fA-F", 16), ("o", "0-7", 8), ("b", "01", 2))])
    value = F.coalesce(decimal, radix)
    return F.when(F.abs(value) < float("inf"), value)


def once(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def number_text(x: Column) -> Column:
    """The shortest text that reads back as the same number, null for null; exponents from 1e21 and below 1e-6."""
    a = F.abs(x)
    whole = (a < 1e15) & (x == F.floor(x))
    plain = F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull(), None).when(whole, x.cast("bigint").cast("string")).when((a >= 1e-3) & (a < 1e7), plain).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), once(_shortest(a), _exponent_text)))


def _shortest(a: Column) -> Column:
    """The fewest of 15 to 17 digits that read back as the same number, as d.ddde+n."""
    tries = [F.format_string(f"%.{n}e", a) for n in (14, 15, 16)]
    return F.coalesce(*[F.when(t.try_cast("double") == a, t) for t in tries[:2]], tries[2])


def _exponent_text(s: Column) -> Column:
    """Text of a positive number that is written with an exponent, from d.ddde+n."""
    mantissa = F.regexp_extract(s, r"^([0-9.]+)", 1)
    exponent = F.coalesce(F.regexp_extract(s, r"e([+-][0-9]+)$", 1).try_cast("int"), F.lit(0))
    first, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    parts = F.struct(F.concat(first, part).alias("digits"), (F.length(first) + exponent).cast("int").alias("point"))
    return once(parts, lambda p: _placed(p["digits"], p["point"]))


def _placed(digits: Column, point: Column) -> Column:
    n = F.length(digits)
    plain = F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)).when(point >= n, F.rpad(digits, point, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
    e = point - 1
    more = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
    scientific = F.concat(F.substring(digits, 1, 1), more, F.lit("e"), F.when(e > 0, "+").otherwise("-"), F.abs(e).cast("string"))
    return F.when((point > -6) & (point <= 21), plain).otherwise(scientific)


def wildcard_pattern(criterion: str) -> str:
    """A regular expression for a whole text: * any signs, ? one sign, ~ takes the next sign as it is; no case."""
    out, i = "", 0
    while i < len(criterion):
        c = criterion[i]
        if c == "~" and i + 1 < len(criterion):
            i += 1
            out += re.escape(criterion[i])
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return rf"(?iu)\A{out}\z"


def matches_wildcard(text: Column, criterion: str) -> Column:
    return text.rlike(wildcard_pattern(criterion))
