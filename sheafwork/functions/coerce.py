"""What counts as a number, as missing, and of which kind a cell is.

Five rules exist side by side because the operators that use them differ in what they strip; all refuse
`1_000`, `5d`, `nan` and `inf`, and none raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Texts that mean a missing cell (fixed values).
MISSING = ("", "null", "none", "n/a", "na", "-", "#n/a", "#null!")


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def _text(value: Column) -> Column:
    """A boolean counts as 1 or 0 wherever numbers are wanted."""
    plain = value.cast("string")
    return F.when(plain == "true", "1").when(plain == "false", "0").otherwise(plain)


def num_agg(value: Column) -> Column:
    """Aggregation: outer blanks, `,` and `$ € £` go; a trailing % divides by 100."""
    text = F.regexp_replace(F.trim(_text(value)), "[,$€£]", "")
    percent = text.endswith("%")
    return F.when(percent, _number(F.trim(F.regexp_replace(text, "%$", ""))) / 100).otherwise(_number(F.trim(text)))


def num_cmp(value: Column) -> Column:
    """Comparison and summaries: `,` `$` `%` go, the percent sign without effect."""
    return _number(F.trim(F.regexp_replace(_text(value), "[,$%]", "")))


def num_anom(value: Column) -> Column:
    """Anomalies: currency signs, %, commas and white space go wherever they stand."""
    return _number(F.regexp_replace(_text(value), r"[$€£¥₹%,\s]", ""))


def num_diff(value: Column) -> Column:
    """Differences between files: nothing goes but outer white space."""
    return _number(F.trim(_text(value)))


def num_unit(text: Column) -> Column:
    """The digits of a value with a unit: commas go; exact decimals."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.when(plain.rlike(NUMBER), plain.try_cast("decimal(38,10)"))


def plain_number(value: Column, dtype: str, rule=num_agg) -> Column:
    """`rule` for text columns; numeric columns need no parsing and stay in their own type's arithmetic."""
    if dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal"):
        return value.cast("double")
    return rule(value)


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin(*MISSING)


def value_type(value: Column) -> Column:
    """null, boolean, numeric, date, text: booleans before numbers, numbers before dates."""
    text = F.lower(F.trim(value.cast("string")))
    date = text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ t].*)?$") | text.rlike(r"^[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}$") | text.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$")
    return F.when(is_missing(value), "null").when(text.isin("true", "false", "yes", "no"), "boolean").when(num_anom(value).isNotNull(), "numeric").when(date, "date").otherwise("text")


def percent_change(old: Column, new: Column) -> Column:
    """Per cent from old to new, 2 places; near 0 (|old| < 0.01): 0 if both are, else null."""
    return F.when(F.abs(old) < 0.01, F.when(F.abs(new) < 0.01, 0.0)).otherwise(F.round((new - old) / F.abs(old) * 100, 2))


def trend(change: Column, band: float = 5.0) -> Column:
    return F.when(change.isNull(), "unknown").when(change > band, "increasing").when(change < -band, "decreasing").otherwise("stable")
