"""Display forms of numbers, dates and rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column, places: int = 2) -> Column:
    """Thousands separators, whole numbers without decimals."""
    return F.when(value == F.floor(value), F.format_number(value, 0)).otherwise(F.format_number(value, places))


def currency(value: Column, sign: str = "$", places: int = 2) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise(""), F.lit(sign), F.format_number(F.abs(value), places))


def percentage(value: Column, places: int = 2, times_100: bool = True) -> Column:
    return F.concat(F.format_number(value * 100 if times_100 else value, places), F.lit("%"))


def by_excel_format(value: Column, fmt: Column) -> Column:
    """`$` and `฿` as currency, `%` as per cent, `#,##` with separators, decimals as many as zeros after the point."""
    places = F.length(F.regexp_extract(fmt, r"\.(0+)", 1))
    text = F.call_function("format_number", F.when(fmt.contains("%"), value * 100).otherwise(value), places)
    plain = F.when(fmt.contains("#,##") | fmt.contains("%"), text).otherwise(F.regexp_replace(text, ",", ""))
    return F.when(fmt.contains("$"), F.concat(F.lit("$"), text)).when(fmt.contains("฿"), F.concat(F.lit("฿"), text)).when(fmt.contains("%"), F.concat(F.regexp_replace(plain, ",", ""), F.lit("%"))).otherwise(plain)


def day(value: Column, style: str = "iso", thai: bool = False) -> Column:
    """long (January 5, 2024), short (05/01/2024) or iso; Buddhist years are 543 larger."""
    year = F.year(value) + (543 if thai else 0)
    if style == "long":
        return F.concat(F.date_format(value, "MMMM d, "), year.cast("string"))
    if style == "short":
        return F.concat(F.date_format(value, "dd/MM/"), year.cast("string"))
    return F.concat(year.cast("string"), F.date_format(value, "-MM-dd"))


def stripped(value: Column, places: int = 6) -> Column:
    """Whole numbers as such, others rounded with trailing zeros removed."""
    return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.round(value, places).cast("decimal(38,10)").cast("string"), "0+$", ""), r"\.$", ""))


def row_text(columns: list[str]) -> Column:
    """`name: value, name: value`, leaving nulls out."""
    return F.concat_ws(", ", *[F.when(F.col(f"`{c}`").isNotNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in columns])


def markdown_row(columns: list[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
