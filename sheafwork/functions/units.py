"""Units of measure: detection, conversion, unit-aware aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coerce import num_unit

#: unit, category and factor to the category's base unit (fixed values).
UNITS = (
    ("mg", "weight", "0.000001"), ("g", "weight", "0.001"), ("kg", "weight", "1"), ("t", "weight", "1000"), ("oz", "weight", "0.028349523125"), ("lb", "weight", "0.45359237"), ("ton", "weight", "907.185"),
    ("mm", "length", "0.001"), ("cm", "length", "0.01"), ("m", "length", "1"), ("km", "length", "1000"), ("in", "length", "0.0254"), ("ft", "length", "0.3048"), ("yd", "length", "0.9144"), ("mi", "length", "1609.344"),
    ("ml", "volume", "0.001"), ("l", "volume", "1"), ("gal", "volume", "3.785411784"),
    ("m²", "area", "1"), ("km²", "area", "1000000"), ("ft²", "area", "0.092903"), ("ha", "area", "10000"), ("acre", "area", "4046.8564224"),
)
CURRENCIES = ("$", "€", "£", "¥", "₹", "CHF", "CAD", "AUD", "฿", "₩", "₽")
#: Other spellings, in lower case (fixed values).
_SPELLED = {
    "usd": "$", "eur": "€", "gbp": "£", "chf": "CHF", "cad": "CAD", "aud": "AUD", "pct": "%", "percent": "%",
    "lbs": "lb", "tons": "ton", "mile": "mi", "miles": "mi", "feet": "ft", "foot": "ft", "inch": "in", "inches": "in", "yard": "yd", "yards": "yd",
    "liter": "l", "liters": "l", "litre": "l", "litres": "l", "gallon": "gal", "gallons": "gal",
    "m2": "m²", "sq m": "m²", "sqm": "m²", "km2": "km²", "sq km": "km²", "sq ft": "ft²", "sqft": "ft²", "acres": "acre",
}


def detect_unit(text: Column) -> Column:
    """A struct (value, unit, category), null without a number: currency signs and codes before, units or currency codes
    after, per cent signs and words. A minus stands before the number or before its currency."""
    plain = F.trim(text)
    before = F.upper(F.regexp_extract(plain, r"^-?\s*([$€£¥₹฿₩₽]|(?i:CHF|CAD|AUD))\s*-?[0-9][0-9,]*\.?[0-9]*$", 1))
    minus = plain.rlike(r"^-|^([$€£¥₹฿₩₽]|(?i:CHF|CAD|AUD))\s*-")
    number = F.regexp_extract(plain, r"([0-9][0-9,]*\.?[0-9]*)", 1)
    after = F.lower(F.regexp_extract(plain, r"[0-9]\s*((?:sq\s+)?[A-Za-z%²€£]+2?)$", 1))
    after = F.regexp_replace(after, r"\s+", " ")
    pairs = [x for kv in _SPELLED.items() for x in kv]
    spelled = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in pairs]), after), after)
    unit = F.when(before != "", before).when(spelled != "", spelled)
    kinds = F.create_map(*[F.lit(x) for u, c, _ in UNITS for x in (u, c)])
    category = F.when(unit.isin(*CURRENCIES), "currency").when(unit == "%", "percentage").otherwise(F.coalesce(F.try_element_at(kinds, unit), F.lit("unknown")))
    category = F.when(unit.isNull(), "none").otherwise(category)
    value = num_unit(number)
    value = F.when(minus, -value).otherwise(value)
    return F.when(value.isNotNull(), F.struct(value.alias("value"), unit.alias("unit"), category.alias("category")))


def convert(value: Column, source: Column, target: Column) -> Column:
    """In decimals through the base unit; null between different categories."""
    factors = F.create_map(*[x for u, c, f in UNITS for x in (F.lit(u), F.struct(F.lit(c).alias("c"), F.lit(f).cast("decimal(20,12)").alias("f")))])
    a, b = F.try_element_at(factors, source), F.try_element_at(factors, target)
    return F.when(a["c"] == b["c"], (value.cast("double") * a["f"].cast("double") / b["f"].cast("double")).cast("decimal(30,6)"))


def aggregate_units(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Sum, mean, least, largest and count of values with units; no conversion, a flag where units are mixed."""
    found = df.withColumn("_u", detect_unit(F.col(column).cast("string")))
    value = F.col("_u.value")
    out = found.groupBy(*(by or [])).agg(
        F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"), F.count(value).alias("n"),
        (F.count("*") - F.count(value)).alias("skipped"), F.count_distinct("_u.unit").alias("units"), F.mode("_u.unit", True).alias("unit"),
    )
    return out.withColumn("mean", F.try_divide(F.col("total").cast("double"), F.col("n"))).withColumn("mixed", F.col("units") > 1)
