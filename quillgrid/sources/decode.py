"""Typed cell values from their raw text and type mark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.text import text_number


def decode_cells(cells: DataFrame, kind: str, raw: str) -> DataFrame:
    """cells with a struct value (tag, num, str, bool, err) from a type mark (inlineStr, s, str, b, e, d, n or null) and the raw text; shared strings must be resolved."""
    k, text = F.coalesce(F.col(kind), F.lit("n")), F.col(raw)
    there = text.isNotNull() & ((F.col(raw) != "") | k.isin("inlineStr", "s", "str"))
    tag = F.when(~there, "blank").when(k.isin("inlineStr", "s", "str"), "string").when(k == "b", "boolean").when(k == "e", "error").when(k == "d", "date").otherwise("number")
    value = F.struct(
        tag.alias("tag"),
        F.when(tag == "number", text_number(text)).alias("num"),
        F.when(tag.isin("string", "date"), text).alias("str"),
        F.when(tag == "boolean", F.lower(text).isin("1", "true")).alias("bool"),
        F.when(tag == "error", text).alias("err"),
    )
    return cells.withColumn("value", value)
