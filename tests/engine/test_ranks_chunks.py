"""Ranks by group, chunk filters, strategies, languages of sheets."""

import numpy as np
from pyspark.sql import functions as F

from sheafwork.operators import aggregate, chunks, metrics, profile, rows, sheets


def test_percentiles_by_group_equal_numpy(spark):
    rng = np.random.default_rng(4)
    data = [(None if i % 11 == 0 else f"g{min(int(rng.zipf(1.6)), 6)}", float(np.round(rng.normal(), 2)) if i % 7 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, v double").repartition(6)
    found = {r.k: r for r in profile.percentiles(df, F.col("v"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["k"]).collect()}
    groups = {}
    for k, v in data:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert found.keys() == groups.keys()
    for k, v in groups.items():
        assert found[k].n == len(v) and np.allclose([found[k].p50, found[k].p95, found[k].p99], np.quantile(v, [0.5, 0.95, 0.99]))
    stats = {r.k: r for r in metrics.histogram_stats(df, "k", "v").collect()}
    assert stats[None].n == len(groups[None]) and np.isclose(stats[None].p50, np.median(groups[None]))


def test_median_by_group_counts_skipped_cells(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "3"), ("b", "n/k"), (None, "5")], "g string, v string")
    got = {r.g: (r.value, r.rows_processed, r.rows_skipped) for r in aggregate.aggregate(df, "median", "v", by=["g"]).collect()}
    assert got == {"a": (2.0, 2, 1), "b": (None, 0, 1), None: (5.0, 1, 0)}
    whole = aggregate.aggregate(df, "median", "v").first()
    assert (whole.value, whole.rows_processed, whole.rows_skipped) == (3.0, 3, 2)
    none = aggregate.aggregate(df.limit(0), "median", "v").first()
    assert (none.value, none.rows_processed, none.rows_skipped) == (None, 0, 0)


def test_recent_histogram_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(50)] + [("b", 1, 7.0)], "k string, at int, v double")
    got = {r.k: (r.n, r.least, r.largest, r.p50) for r in metrics.histogram_stats(df, "k", "v", [F.desc("at")], 10).collect()}
    assert got == {"a": (10, 40.0, 49.0, 44.5), "b": (1, 7.0, 7.0, 7.0)}


def test_chunk_conditions(spark):
    stored = [(1, "f", "s", "Sheet: Sales_2024", 0.9, True, False), (2, "f", "t", "sheet: salesX2024", 0.5, True, True), (3, "g", "s", None, None, None, True)]
    df = spark.createDataFrame(stored, "id int, file_id string, extraction_strategy string, chunk_text string, quality_score double, has_numbers boolean, has_dates boolean")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(chunks.chunk_condition()) == [1, 2, 3]
    assert ids(chunks.chunk_condition(sheet_name="SALES_2024")) == [1, 2]  # _ is a wildcard
    assert ids(chunks.chunk_condition(file_id="f", strategy="s")) == [1]
    assert ids(chunks.chunk_condition(least_quality=0.6)) == [1]
    assert ids(chunks.analysis_condition(["numbers"])) == [1, 2]
    assert ids(chunks.analysis_condition(["numbers", "dates"])) == [2]
    assert ids(chunks.analysis_condition([], {"file_id": "g"})) == [3]


def test_strategies_and_ties(spark):
    df = spark.createDataFrame([("f", "b", 1.0), ("f", "a", 0.5), ("f", "a", 1.5), ("f", "c", 0.2), ("g", "x", 0.1)], "file string, strategy string, score double")
    got = {r.file: (r.strategies, r.best_strategy, r.best_score, round(r.lead, 6)) for r in chunks.compare_strategies(df, "file", "strategy", "score").collect()}
    assert got == {"f": (3, "a", 1.0, round(1 - 2.2 / 3, 6)), "g": (1, "x", 0.1, 0.0)}


def test_languages_and_counts(spark):
    raw = [("f", "a", 1, ["หัวข้อ", None]), ("f", "a", 2, ["ยอดขาย", "12"]), ("f", "b", 1, ["Total"]), ("f", "b", 2, ["sales of the year in all regions"]), ("f", "c", 1, None), ("g", "a", 1, ["123"])]
    df = spark.createDataFrame(raw, "file_name string, sheet_name string, row_idx long, cells array<string>")
    assert {(r.file_name, r.sheet_name): r.language for r in sheets.sheet_languages(df).collect()} == {("f", "a"): "th", ("f", "b"): "en", ("g", "a"): "en"}
    assert {r.file_name: r.language for r in sheets.workbook_languages(df).collect()} == {"f": "en", "g": "en"}
    counts = rows.comparison_counts({"a": df, "b": df.drop("cells")}, ["sheet_name", "cells"]).first()
    assert tuple(counts) == (2, 2, 12, 1)
