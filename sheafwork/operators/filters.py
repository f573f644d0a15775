"""Typed filters and lookups."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import NUMBER, num_agg
from . import rows

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
_CLAUSE = re.compile(r"(.+?)\s*(<=|>=|!=|=|<|>)\s*(.+)")


def parse_filter(text: str, columns: list[str]) -> tuple[str, str, str] | None:
    """`column op value`, longest operator first, or `column words` as contains; None without a known column."""
    names = {c.lower(): c for c in columns}
    if m := _CLAUSE.fullmatch(text.strip()):
        name = names.get(m[1].strip().lower())
        return (name, m[2], m[3].strip().strip("'\"")) if name else None
    for low in sorted(names, key=len, reverse=True):
        if text.strip().lower().startswith(low + " "):
            return names[low], "contains", text.strip()[len(low) :].strip()
    return None


def condition(df: DataFrame, column: str, op: str, value: str | float) -> Column:
    """Numbers where both sides are, else lower-cased text; a null cell never matches, not even `!=`.

    A numeric or date column is compared as it is, so the predicate reaches the Parquet scan.
    """
    col, dtype = F.col(f"`{column}`"), dict(df.dtypes)[column]
    text = str(value)
    as_number = float(text) if re.match(NUMBER, text.strip()) else None

    def test(a: Column, b) -> Column:
        return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

    if op == "contains":
        return F.lower(col.cast("string")).contains(text.lower())
    if dtype in NUMERIC or dtype.startswith("decimal"):
        return test(col, F.lit(as_number)) if as_number is not None else test(F.lower(col.cast("string")), text.lower())
    if dtype.startswith(("timestamp", "date")):
        return test(col, F.lit(text).cast(dtype))
    words = test(F.lower(col), text.lower())
    return words if as_number is None else F.coalesce(test(num_agg(col), F.lit(as_number)), words)


def apply_filters(df: DataFrame, filters: list[tuple[str, str, str | float]]) -> DataFrame:
    return reduce(lambda d, f: d.where(condition(df, *f)), filters, df)


def matches(col: Column, value: str, how: str) -> Column:
    text, wanted = F.lower(F.trim(col.cast("string"))), value.strip().lower()
    return {"exact": text == wanted, "contains": text.contains(wanted), "starts_with": text.startswith(wanted), "ends_with": text.endswith(wanted)}[how]


def lookup(df: DataFrame, value: str, column: str | None = None, how: str = "contains", limit: int = 10, order: list[str] | None = None) -> DataFrame:
    """Matching rows, the first `limit` in `order` (all columns by default), with total_matches.

    The total is one aggregate of the same filter, not a window over all matches.
    """
    columns = [column] if column else df.columns
    hit = reduce(lambda a, b: a | b, [F.coalesce(matches(F.col(f"`{c}`"), value, how), F.lit(False)) for c in columns])
    found = df.where(hit)
    total = found.agg(F.count("*").alias("total_matches"))
    return found.orderBy(*(order or df.columns)).limit(limit).join(F.broadcast(total))


def cell(df: DataFrame, reference: str, order: list[str]) -> DataFrame:
    """The value at a reference such as B10 (row 1 holds the headers), rows in `order`; no row out of range."""
    m = re.fullmatch(r"([A-Za-z]+)([0-9]+)", reference.strip())
    if not m:
        raise ValueError(f"not a cell reference: {reference}")
    index = reduce(lambda n, c: n * 26 + ord(c) - 64, m[1].upper(), 0) - 1
    if index >= len(df.columns) or int(m[2]) < 2:
        raise ValueError(f"out of range: {reference}")
    name = df.columns[index]
    return rows.rows_at(df, order, int(m[2]) - 2, 1).select(F.lit(reference.upper()).alias("cell"), F.lit(name).alias("column"), F.col(f"`{name}`").cast("string").alias("value"))


def column_letter(index: int) -> str:
    out = ""
    while index >= 0:
        out, index = chr(65 + index % 26) + out, index // 26 - 1
    return out


def page(df: DataFrame, order: list, number: int, size: int = 20) -> DataFrame:
    """Page `number` (from 1) of at most 100 rows; deep pages come from a row index, see also rows.page_after."""
    size = min(size, 100)
    return rows.rows_at(df, order, (number - 1) * size, size)
