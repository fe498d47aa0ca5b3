"""Scalar rules shared by both back ends, for Python values: coercions, number text and comparison."""

from __future__ import annotations

import math
import re
import unicodedata
from decimal import Decimal
from typing import NamedTuple


class Value(NamedTuple):
    """A cell value: blank, boolean, date, error, number or string."""

    tag: str
    value: object = None


BLANK = Value("blank")
NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
RADIX = re.compile(r"0(?:[xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)\Z")
WHITE = " \t\n\v\f\r                 　﻿"


def number(x: float) -> Value:
    """A number, or the error of one that isn't finite; no negative zero."""
    return Value("number", x + 0.0) if math.isfinite(x) else Value("error", "#NUM!")


def text_number(text: str) -> float | None:
    """The number a text stands for; None where it is empty, none, or not finite."""
    t = text.strip(WHITE)
    if NUMBER.match(t):
        x = float(t)
        return x if math.isfinite(x) else None
    return float(int(t, 0)) if RADIX.match(t) else None


def number_text(x: float) -> str:
    """The shortest text that reads back as the same number; exponents from 1e21 and below 1e-6."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(float(x))).normalize().as_tuple()
    d = "".join(map(str, digits))
    point = len(d) + exponent
    if -6 < point <= 0:
        out = "0." + "0" * -point + d
    elif 0 < point <= 21:
        out = d + "0" * (point - len(d)) if point >= len(d) else d[:point] + "." + d[point:]
    else:
        e = point - 1
        out = d[0] + ("." + d[1:] if len(d) > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return "-" * sign + out


def to_text(v: Value) -> str:
    if v.tag == "number":
        return number_text(v.value)
    if v.tag == "boolean":
        return "TRUE" if v.value else "FALSE"
    return "" if v.tag == "blank" else str(v.value)


def to_number(v: Value) -> Value:
    if v.tag in ("number", "error"):
        return v
    if v.tag == "blank":
        return Value("number", 0.0)
    if v.tag == "boolean":
        return Value("number", float(v.value))
    x = text_number(v.value)
    return Value("error", "#VALUE!") if x is None else Value("number", x)


def to_logical(v: Value) -> Value:
    if v.tag in ("boolean", "error"):
        return v
    if v.tag == "blank":
        return Value("boolean", False)
    if v.tag == "number":
        return Value("boolean", v.value != 0)
    word = v.value.upper()
    return Value("boolean", word == "TRUE") if word in ("TRUE", "FALSE") else Value("error", "#VALUE!")


def base_letters(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def natural_key(text: str, case: bool = False) -> tuple:
    """Orders text with numbers by value; letters without regard to case and accents, unless case is asked for, which then decides among equal ones, lower case first."""
    parts = re.findall(r"[0-9]+|[^0-9]+", base_letters(text))
    base = tuple((0, int(p), "") if p[0].isdigit() else (1, 0, p) for p in parts)
    return (base, text.swapcase()) if case else (base,)


def compare(a: Value, b: Value) -> int:
    """-1, 0 or 1: numbers and booleans among themselves by value, all else by text."""
    if a.tag == b.tag and a.tag in ("number", "boolean", "blank"):
        x, y = (a.value, b.value) if a.tag != "blank" else (0, 0)
    else:
        x, y = natural_key(to_text(a)), natural_key(to_text(b))
    return (x > y) - (x < y)
