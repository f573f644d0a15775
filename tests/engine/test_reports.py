"""Reports: empty tables, nulls, ties and hand-made cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import text
from sheafwork.operators import align, reports


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("found", "wanted", "kind", "score"),
    [
        (date(2024, 3, 1), date(2024, 9, 9), "year", 1.0), (date(2023, 3, 1), date(2024, 3, 9), "year", 0.0), (date(2024, 3, 1), date(2024, 3, 31), "month", 1.0),
        (date(2023, 3, 1), date(2024, 3, 31), "month", 0.5), (date(2023, 4, 1), date(2024, 3, 31), "month", 0.0), (date(2024, 4, 1), date(2024, 6, 30), "quarter", 1.0),
        (date(2024, 1, 8), date(2024, 1, 1), "date", 0.5), (date(2024, 1, 9), date(2024, 1, 1), "date", 0.0), (date(2024, 1, 16), date(2024, 1, 1), "relative", 0.75),
        (date(2024, 1, 1), date(2024, 1, 1), "other", 1.0), (None, date(2024, 1, 1), "year", 0.0), (date(2024, 1, 1), None, "month", 0.0),
    ],
)
def test_date_match(spark, found, wanted, kind, score):
    assert value(spark, reports.date_match(F.lit(found).cast("date"), F.lit(wanted).cast("date"), F.lit(kind))) == pytest.approx(score)


def test_date_label(spark):
    day = F.lit("2024-05-17").cast("date")
    assert [value(spark, reports.date_label(day, F.lit(k))) for k in ("year", "month", "quarter", "date")] == ["2024", "May 2024", "Q2 2024", "2024-05-17"]


def test_preference_matches(spark):
    stored = spark.createDataFrame([("Total sales?", date(2024, 1, 1)), ("total   sale", date(2023, 1, 1)), ("", date(2024, 1, 1)), (None, date(2024, 1, 1)), ("something else", date(2024, 1, 1))], "q string, at date")
    out = reports.preference_matches(stored, "total sales", "q", "at", F.lit("2024-01-05").cast("date")).collect()
    assert [(r.q, round(r.similarity, 4)) for r in out] == [("Total sales?", 1.0), ("total   sale", 0.9091)]
    assert out[0].score == 1 and out[1].score == pytest.approx(0.9091 * 0.1, abs=1e-4)


def test_needs_clarification(spark):
    hits = spark.createDataFrame([("a", 0.9), ("a", 0.5), ("b", 0.9), ("b", 0.88), ("c", 0.6), ("d", 0.8), ("e", 0.9), ("e", 0.9), ("e", None)], "q string, score double")
    assert {r.q: r.clarify for r in reports.needs_clarification(hits, "q", "score").collect()} == {"a": False, "b": True, "c": True, "d": False, "e": True}


def test_majority_ties_and_nulls(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", None), ("x", None), ("x", None), (None, "c"), ("y", None)], "k string, v string")
    assert {(r.k, r.v, r.n) for r in reports.majority(df, "k", "v").collect()} == {("x", "a", 1), (None, "c", 1)}


def test_columns_of_files(spark):
    df = spark.createDataFrame([("f", "id"), ("f", "price"), ("g", "id"), ("h", None)], "file string, name string")
    missing = reports.missing_columns(df, "file", "name")
    assert {r.file: r.missing for r in missing.collect()} == {"f": [], "g": ["price"], "h": ["id", "price"]}
    assert reports.alignment_quality(missing).first().quality == pytest.approx(1 / 3)
    assert [r.name for r in reports.common_values(df.where("file <> 'h'"), "file", "name").collect()] == ["id"]
    empty = reports.missing_columns(df.limit(0), "file", "name")
    assert empty.count() == 0 and reports.alignment_quality(empty).first().quality == 0
    assert reports.common_values(df.limit(0), "file", "name").count() == 0


def test_comparison_table_takes_the_first_row(spark):
    df = spark.createDataFrame([("a", "f", 2, 20.0), ("a", "f", 1, 10.0), ("b", "g", 1, 5.0)], "label string, file string, i int, v double")
    out = {r.label: (r.f, r.g) for r in reports.comparison_table(df, "label", "file", "v", "i", ["f", "g"]).collect()}
    assert out == {"a": (10.0, None), "b": (None, 5.0)}


def test_best_range_keeps_most_confidence(spark):
    df = spark.createDataFrame([(1, 2, 0.5, "x"), (1, 2, 0.9, "z"), (1, 2, 0.9, "y"), (3, None, 0.1, None)], "s int, e int, c double, t string")
    assert {tuple(r) for r in reports.best_ranges(df, "s", "e", "c").collect()} == {(1, 2, 0.9, "y"), (3, None, 0.1, None)}


def test_cached(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, " c "), (3, None)], "id long, text string")
    cache = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], "id long, text string")
    assert {(r.id, r.hit, r.words) for r in reports.cached(docs, cache, "id", "text").collect()} == {(1, True, 2), (2, False, 1), (3, False, 0)}


def test_last_known_and_citations(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "f"), (1, 3, None), (2, 1, None)], "k int, i int, v string")
    assert {(r.k, r.i): r.resolved for r in reports.last_known(df, "k", ["i"], "v").collect()} == {(1, 1): None, (1, 2): "f", (1, 3): "f", (2, 1): None}
    sheets = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "a"), ("g", None)], "file string, sheet string")
    assert {r.file: r.citation for r in reports.citations(sheets, "file", "sheet").collect()} == {"f": "f (a, b)", "g": "g ()"}


def test_admission_takes_the_first_limit(spark):
    rows = spark.createDataFrame([(5.0, 1, 1), (15.0, 9, 9), (5.0, 9, 9), (5.0, 1, 9), (None, 1, 1)], "c double, f int, r int")
    out = rows.select(reports.admission(F.col("c"), F.col("f"), F.col("r"), 10, 5, 5).alias("v")).collect()
    assert [r.v for r in out] == [None, "cost", "files", "rows", None]


def test_question_words(spark):
    ask = lambda q: value(spark, reports.expected_types(F.lit(q)))
    assert ask("How many orders by year") == ["date", "number"] and ask("Who sold it") == ["text"] and ask("") == []
    assert value(spark, reports.temporal_references(F.lit("2024 Q3, again 2024, room 3024"))) == ["2024", "Q3"]
    assert [value(spark, reports.is_key_name(F.lit(c))) for c in ("Order ID", "total")] == [True, False]


def test_change_summary_and_tokens(spark):
    change = lambda a, b: value(spark, text.change_summary(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert change("a\nb\nc", "a\nc\nd") == "1 line(s) added, 1 line(s) removed"
    assert change("a\nb", "a\nx\ny") == "2 line(s) modified"
    assert change("a", "a") == change(None, "") == "No changes detected"
    assert value(spark, text.sorted_tokens(F.lit("Red-bolt, a "))) == "a bolt red"


def test_relationships_of_empty_and_null_columns(spark):
    a = spark.createDataFrame([(1, " X ", None), (2, "y", None), (2, "y", None)], "id int, name string, nothing string")
    b = spark.createDataFrame([(1, "x"), (3, "Y"), (None, None)], "id int, name string")
    tables = {"a": a, "b": b, "e": b.limit(0)}
    pairs = [("a", "id", "b", "id"), ("a", "name", "b", "name"), ("a", "nothing", "b", "name"), ("a", "id", "e", "id")]
    out = {(r.table_2, r.column_1): r for r in align.relationships(tables, pairs, least=0).collect()}
    assert len(out) == 4
    assert out["b", "id"].overlap == 0.5 and out["b", "id"].relationship == "foreign_key"
    assert out["b", "name"].overlap == 1 and out["b", "name"].join_type == "inner"
    assert out["b", "nothing"].overlap == 0 and out["e", "id"].overlap == 0


def test_relationships_derive_all_pairs(spark):
    line = spark.createDataFrame([(i, i % 5, " A ") for i in range(40)], "l_id int, l_partkey int, l_flag string")
    part = spark.createDataFrame([(i, "x") for i in range(5)], "p_partkey int, p_name string")
    flags = spark.createDataFrame([("a", None)], "flag string, nothing string")
    tables = {"line": line, "part": part, "flags": flags}
    out = {(r.table_1, r.column_1, r.table_2, r.column_2): r for r in align.relationships(tables, least=0).collect()}
    assert len(out) == 3 * 2 + 3 * 2 + 2 * 2 and all(a != c for a, _, c, _ in out)
    found = out["line", "l_partkey", "part", "p_partkey"]
    assert found.overlap == 1 and found.relationship == "foreign_key" and found.join_type == "inner"
    assert out["line", "l_flag", "flags", "flag"].overlap == 1 and out["line", "l_flag", "flags", "nothing"].overlap == 0
    given = {(r.table_1, r.column_1, r.table_2, r.column_2): r for r in align.relationships(tables, [k[2:] + k[:2] for k in out], least=0).collect()}
    assert {k[2:] + k[:2]: (r.overlap, r.confidence, r.relationship) for k, r in given.items()} == {k: (r.overlap, r.confidence, r.relationship) for k, r in out.items()}
    assert align.relationships({"line": line}).count() == 0


def test_cells_are_counted_in_their_own_type(spark):
    """every cell became a text before it was counted."""
    from sheafwork.operators import align

    df = spark.sql("SELECT * FROM VALUES (1, 0.5D, 'a', 1.50BD, DATE'2024-01-02'), (1, -0.0D, 'a', 1.50BD, null), (2, 0.0D, null, null, null), (null, double('NaN'), 'b', null, null) t(i, d, s, x, day)")
    parts = align._counted(df, dict(enumerate(df.columns)))
    found = {(r.col, r.raw): r.n for p in parts for r in p.collect()}
    want = {}
    for row in df.select(*[F.col(c).cast("string") for c in df.columns]).collect():
        for i, v in enumerate(row):
            if v is not None:
                want[i, v] = want.get((i, v), 0) + 1
    assert found == want
    assert len(parts) == 4 and (1, "-0.0") in found
