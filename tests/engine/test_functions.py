"""Scalar functions against the definitions' own examples."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import coerce, dates, formats, text, units, vectors


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


CELLS = ["1,234", "$5", "€5", "5%", "x", None, "true", "1_000", "5d", "nan", " 7 ", "(3)", "-2.5e3", ""]


@pytest.mark.parametrize(
    "rule, want",
    [
        (coerce.num_agg, [1234, 5, 5, 0.05, None, None, 1, None, None, None, 7, None, -2500, None]),
        (coerce.num_cmp, [1234, 5, None, 5, None, None, 1, None, None, None, 7, None, -2500, None]),
        (coerce.num_anom, [1234, 5, 5, 5, None, None, 1, None, None, None, 7, None, -2500, None]),
        (coerce.num_diff, [None, None, None, None, None, None, 1, None, None, None, 7, None, -2500, None]),
    ],
)
def test_numeric_rules(spark, rule, want):
    assert values(column(spark, CELLS), rule(F.col("v"))) == want


def test_missing_and_types(spark):
    df = column(spark, [None, "", " N/A ", "-", "0", "Yes", "$3", "2024-01-05", "5/6/2024", "abc", "#NULL!"])
    assert values(df, coerce.is_missing(F.col("v"))) == [True, True, True, True, False, False, False, False, False, False, True]
    assert values(df, coerce.value_type(F.col("v"))) == ["null", "null", "null", "null", "numeric", "boolean", "numeric", "date", "date", "text", "null"]


def test_percent_change(spark):
    df = spark.createDataFrame([(0.001, 0.002), (0.001, 5.0), (1000.0, 1100.0), (100.0, 104.0), (100.0, 90.0)], "a double, b double")
    change = coerce.percent_change(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(change, coerce.trend(change)).collect()] == [(0.0, "stable"), (None, "unknown"), (10.0, "increasing"), (4.0, "stable"), (-10.0, "decreasing")]


def test_text(spark):
    df = column(spark, ["What  is THE total?", "สวัสดี abc", "paid_id", "", None])
    assert values(df, text.normal_query(F.col("v")))[0] == "what is the total"
    assert values(df, text.keywords(F.col("v")))[0] == ["what", "total"]
    assert values(df, text.script_language(F.col("v"))) == ["en", "mixed", "en", "en", "en"]
    one = column(spark, ["paid_id"])
    assert values(one, text.name_similarity(F.col("v"), F.lit("pa"))) == [0.95]
    assert values(one, text.name_similarity(F.col("v"), F.lit("PAID_ID"))) == [1.0]
    keys = values(column(spark, ["Total sales of March", "march: the sales total!"]), text.cache_key(F.col("v")))
    assert keys[0] == keys[1] and len(keys[0]) == 32
    unlike = ["ยอดขายปีนี้เท่าไร", "จำนวนลูกค้าทั้งหมด", "cost-benefit 2024", "costbenefit 2024", "été déjà", "ete deja", ""]
    assert len(set(values(column(spark, unlike), text.cache_key(F.col("v"))))) == len(unlike)
    alike = values(column(spark, ["Cost-benefit 2024?", "benefit: cost 2024", "ÉTÉ déjà", "déjà, été!"]), text.cache_key(F.col("v")))
    assert alike[0] == alike[1] and alike[2] == alike[3]
    assert values(column(spark, ["été, déjà", "ยอดขาย ปีนี้", "the cost-benefit"]), text.keywords(F.col("v"))) == [["été", "déjà"], ["ยอดขาย", "ปีนี้"], ["costbenefit"]]
    assert values(column(spark, ["Price-_Total (EN)"]), text.normal_header(F.col("v"))) == ["price total"]


def test_templates(spark):
    df = column(spark, ["{{a}} of {{ b }} and {{a}}", "no names", "{{zz}}"])
    m = F.create_map(F.lit("a"), F.lit("$1"), F.lit("b"), F.lit("\\x"))
    assert values(df, text.template_parameters(F.col("v"))) == [["a", "b"], [], ["zz"]]
    assert values(df, text.fill_template(F.col("v"), m)) == ["$1 of \\x and $1", "no names", None]


def test_similar_and_diff(spark):
    df = column(spark, ["Revenue", "revenues", "cost", None])
    got = values(df, text.sequence_ratio("revenue")("v"))
    assert got[0] == 1.0 and got[1] > 0.9 > 0.5 > got[2] and got[3] == 0.0
    two = spark.createDataFrame([("a\nb\nc", "a\nc\nd"), (None, "x")], "o string, n string")
    rows = [r[0] for r in two.select(text.line_diff(F.col("o"), F.col("n"))).collect()]
    assert (rows[0].added, rows[0].removed, rows[0].unchanged, rows[0].similarity) == (1, 1, 2, 0.6667)


def test_dates(spark):
    assert dates.fiscal_year_range(2024, 10) == (datetime(2023, 10, 1), datetime(2024, 9, 30, 23, 59, 59))
    assert dates.fiscal_year_range(2024, 1) == (datetime(2024, 1, 1), datetime(2024, 12, 31, 23, 59, 59))
    assert dates.quarter_range(2024, 4) == (datetime(2024, 10, 1), datetime(2024, 12, 31, 23, 59, 59))
    df = column(spark, ["sales YTD", "last 3 days", "Q2 2023 figures", "in February 2024", "during 1999", "nothing", "yesterday"])
    first, last = dates.date_bounds(F.col("v"), date(2024, 5, 17))
    assert values(df, first.cast("string")) == ["2024-01-01", "2024-05-14", "2023-04-01", "2024-02-01", "1999-01-01", None, "2024-05-16"]
    assert values(df, last.cast("string")) == ["2024-05-17", "2024-05-17", "2023-06-30", "2024-02-29", "1999-12-31", None, "2024-05-16"]
    names = column(spark, ["Sales_Jan2024.xlsx", "r_2023-07.csv", "Q3_2022", "x1998y", "none"])
    assert values(names, dates.filename_date(F.col("v"))) == ["2024-01", "2023-07", "2022-07", "1998", None]
    ages = column(spark, ["2024-05-01", "2023-01-01", "2024-03-18"])
    ref = F.lit("2024-05-17").cast("date")
    assert values(ages, F.round(dates.decay(F.col("v").cast("date"), ref), 4)) == [1.0, 0.1, 0.7071]
    assert values(ages, F.round(dates.recency(F.col("v").cast("date"), ref), 4)) == [1.0, 0.5, 0.9552]
    serial = column(spark, ["45292.5", "2024-01-01", "5/2/2024", "?"])
    assert values(serial, F.date_format(dates.parse_date(F.col("v")), "yyyy-MM-dd HH")) == ["2024-01-01 12", "2024-01-01 00", "2024-02-05 00", None]


def test_units(spark):
    df = column(spark, ["5 m²", "5 m", "$1,200.50", "12 pct", "7", "none", None, "3.5 kg"])
    got = values(df, units.detect_unit(F.col("v")))
    assert [(float(g.value), g.unit, g.category) if g else None for g in got] == [(5, "m²", "area"), (5, "m", "length"), (1200.5, "$", "currency"), (12, "%", "percentage"), (7, None, "none"), None, None, (3.5, "kg", "weight")]
    spelled = ["CHF 100", "cad5", "AUD 7", "5 USD", "3 lbs", "2 tons", "1 ton", "4 ft²", "4 sqft", "9 sq ft", "3 miles", "6 feet", "1 inch", "2 yards", "8 liters", "1 gallon", "2 acres", "5 sq km", "-3 kg", "-$4", "$-4", "50 percent"]
    found = values(column(spark, spelled), units.detect_unit(F.col("v")))
    assert [g.unit for g in found] == ["CHF", "CAD", "AUD", "$", "lb", "ton", "ton", "ft²", "ft²", "ft²", "mi", "ft", "in", "yd", "l", "gal", "acre", "km²", "kg", "$", "$", "%"]
    assert [float(g.value) for g in found[-4:]] == [-3, -4, -4, 50] and "unknown" not in [g.category for g in found]
    one = spark.range(1)
    assert float(one.select(units.convert(F.lit(2), F.lit("km"), F.lit("m"))).first()[0]) == 2000 and one.select(units.convert(F.lit(2), F.lit("km"), F.lit("kg"))).first()[0] is None
    mixed = units.aggregate_units(column(spark, ["1 kg", "2 kg", "3 m", "x"]), "v").first()
    assert (float(mixed.total), mixed.n, mixed.skipped, mixed.unit, mixed.mixed) == (6, 3, 1, "kg", True)


def test_formats(spark):
    df = spark.createDataFrame([(0, 1234.5), (1, -3.0)], "i int, v double")
    assert values(df, formats.number(F.col("v"))) == ["1,234.50", "-3"]
    assert values(df, formats.currency(F.col("v"))) == ["$1,234.50", "-$3.00"]
    assert values(df, formats.percentage(F.col("v"), 1, False)) == ["1,234.5%", "-3.0%"]
    assert values(df, formats.by_excel_format(F.col("v"), F.lit("$#,##0.00"))) == ["$1,234.50", "$-3.00"]
    assert values(df, formats.stripped(F.col("v"))) == ["1234.5", "-3"]
    assert values(df, formats.row_text(["i", "v"]))[0] == "i: 0, v: 1234.5"


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])], "i int, v array<float>")
    got = values(df, F.round(vectors.cosine_to(F.col("v"), [1.0, 0.0]), 6))
    assert got == [1.0, 0.707107, None]
