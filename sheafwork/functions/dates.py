"""Dates: ranges to a reference date, fiscal calendars, scores by age."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Excel counts days from here (fixed value).
EXCEL_EPOCH = "1899-12-30"
_MONTHS = {m: i + 1 for i, m in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"))}


def to_date_start(kind: str, reference: Column) -> Column:
    """Start of the year, quarter or month to date."""
    return F.date_trunc({"ytd": "year", "qtd": "quarter", "mtd": "month"}[kind], reference)


def quarter_label(value: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(value).cast("string"), F.lit(" "), F.year(value).cast("string"))


def fiscal_year(value: Column, month: int = 10, day: int = 1) -> Column:
    """The fiscal year a date lies in; one that starts after January 1 is named after the year it ends in."""
    if (month, day) == (1, 1):
        return F.year(value)
    after = (F.month(value) > month) | ((F.month(value) == month) & (F.dayofmonth(value) >= day))
    return F.year(value) + after.cast("int")


def fiscal_quarter(value: Column, month: int = 10) -> Column:
    """Quarters of three calendar months from the fiscal start month."""
    return (F.floor(((F.month(value) - month + 12) % 12) / 3) + 1).cast("int")


def fiscal_year_range(year: int, month: int = 10, day: int = 1) -> tuple[datetime, datetime]:
    first = date(year if (month, day) == (1, 1) else year - 1, month, day)
    last = date(first.year + 1, month, day) - timedelta(days=1)
    return datetime(first.year, first.month, first.day), datetime(last.year, last.month, last.day, 23, 59, 59)


def quarter_range(year: int, quarter: int) -> tuple[datetime, datetime]:
    first = datetime(year, 3 * quarter - 2, 1)
    after = datetime(year + quarter // 4, (3 * quarter) % 12 + 1, 1)
    return first, after - timedelta(seconds=1)


def recency(value: Column, reference: Column) -> Column:
    """1 up to 30 days old, falling evenly to 0.5 at 365 days and after."""
    days = F.datediff(reference, value)
    return F.when(days <= 30, 1.0).when(days >= 365, 0.5).otherwise(1.0 - (days - 30) / 335.0 * 0.5)


def decay(value: Column, reference: Column) -> Column:
    """1 up to 30 days old, then halved every 60 days, 0.1 at least."""
    days = F.datediff(reference, value)
    return F.when(days <= 30, 1.0).otherwise(F.greatest(F.lit(0.1), F.pow(F.lit(0.5), (days - 30) / 60.0)))


def excel_serial(value: Column) -> Column:
    """Days since the Excel epoch, fractions as time of day."""
    days = F.floor(value.cast("double"))
    midnight = F.timestamp_add("DAY", days.cast("int"), F.lit(EXCEL_EPOCH).cast("timestamp"))
    return F.timestamp_add("SECOND", F.round((value - days) * 86400).cast("int"), midnight)


def parse_date(value: Column) -> Column:
    """The first of ISO, day/month/year, month-name forms that fits, then an Excel serial."""
    text = F.trim(value.cast("string"))
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "d-M-yyyy", "d MMM yyyy", "MMM d, yyyy")
    serial = F.when(text.rlike(r"^[0-9]{4,5}(\.[0-9]+)?$"), excel_serial(text.try_cast("double")))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in forms], serial)


def filename_date(name: Column) -> Column:
    """year-month found in a file name: 2024-03, 202403, Mar2024, March_2024, Q1 2024 or the year alone."""
    low = F.lower(name)
    year_month = F.regexp_extract(low, r"((?:19|20)[0-9]{2})[-_]?(0[1-9]|1[0-2])(?![0-9])", 0)
    named = F.regexp_extract(low, r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-_ ]?((?:19|20)[0-9]{2})", 0)
    quarter = F.regexp_extract(low, r"q([1-4])[-_ ]?((?:19|20)[0-9]{2})", 0)
    year = F.regexp_extract(low, r"((?:19|20)[0-9]{2})", 1)
    order = F.array(*[F.lit(m[:3]) for m in _MONTHS])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return (
        F.when(year_month != "", F.concat(F.substring(year_month, 1, 4), F.lit("-"), F.substring(year_month, -2, 2)))
        .when(named != "", F.concat(F.substring(named, -4, 4), F.lit("-"), two(F.array_position(order, F.substring(named, 1, 3)))))
        .when(quarter != "", F.concat(F.substring(quarter, -4, 4), F.lit("-"), two(F.substring(quarter, 2, 1).cast("int") * 3 - 2)))
        .when(year != "", year)
    )


def date_bounds(text: Column, reference: date) -> tuple[Column, Column]:
    """First and last day that a phrase means, as columns over a column of questions: ytd, qtd, mtd, today,
    yesterday, `last N days|weeks|months|years`, `QN YYYY`, `MONTH YYYY` and a year; nulls where none is named."""
    low, ref = F.lower(text), F.lit(reference.isoformat()).cast("date")
    n = F.regexp_extract(low, r"(?:last|past) ([0-9]+) (?:day|week|month|year)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"(?:last|past) [0-9]+ (day|week|month|year)", 1)
    month = F.regexp_extract(low, r"\b(" + "|".join(_MONTHS) + r") (?:of )?([12][0-9]{3})", 1)
    month_year = F.regexp_extract(low, r"\b(" + "|".join(_MONTHS) + r") (?:of )?([12][0-9]{3})", 2).try_cast("int")
    number = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), month).cast("int")
    quarter, quarter_year = (F.regexp_extract(low, r"\bq([1-4]) ?([12][0-9]{3})", g).try_cast("int") for g in (1, 2))
    year = F.regexp_extract(low, r"\b([12][0-9]{3})\b", 1).try_cast("int")
    first_month, first_quarter = F.make_date(month_year, F.greatest(number, F.lit(1)), F.lit(1)), F.make_date(quarter_year, quarter * 3 - 2, F.lit(1))
    start = (
        F.when(low.rlike(r"\bytd\b|year to date"), F.trunc(ref, "year")).when(low.rlike(r"\bqtd\b|quarter to date"), F.trunc(ref, "quarter")).when(low.rlike(r"\bmtd\b|month to date"), F.trunc(ref, "month"))
        .when(low.contains("yesterday"), F.date_sub(ref, 1)).when(low.contains("today"), ref)
        .when(unit == "day", F.date_sub(ref, n)).when(unit == "week", F.date_sub(ref, n * 7)).when(unit == "month", F.add_months(ref, -n)).when(unit == "year", F.add_months(ref, -n * 12))
        .when(quarter_year.isNotNull(), first_quarter).when(month_year.isNotNull(), first_month).when(year.isNotNull(), F.make_date(year, F.lit(1), F.lit(1)))
    )
    end = (
        F.when(low.contains("yesterday"), F.date_sub(ref, 1)).when(low.rlike(r"\b[yqm]td\b|to date|today") | (unit != ""), ref)
        .when(quarter_year.isNotNull(), F.last_day(F.add_months(first_quarter, 2))).when(month_year.isNotNull(), F.last_day(first_month)).when(year.isNotNull(), F.make_date(year, F.lit(12), F.lit(31)))
    )
    return start, end
