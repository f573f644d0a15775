"""Operators on hand-made frames with known results."""

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import access, aggregate, align, anomaly, chunks, compare, filters, incremental, metrics, profile, ranking, retrieval, stores
from sheafwork.plans import question


def test_filter_null_law(spark):
    df = spark.createDataFrame([(None,), ("a",), ("b",)], "x string")
    assert [r.x for r in filters.apply_filters(df, [("x", "!=", "a")]).collect()] == ["b"]


def test_filters(spark):
    df = spark.createDataFrame([("10", "Paris"), ("$9", "parma"), ("x", "Rome"), (None, None)], "n string, city string")
    pick = lambda t: [r.city for r in filters.apply_filters(df, [filters.parse_filter(t, df.columns)]).collect()]
    assert pick("n >= 9.5") == ["Paris", "Rome"] and pick("n < 10") == ["parma"] and pick("city par") == ["Paris", "parma"] and pick("city = ROME") == ["Rome"]
    assert filters.parse_filter("price > 1", df.columns) is None


def test_numeric_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = aggregate.aggregate(df, "sum", "l_tax", [("l_quantity", ">=", 30)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,30.0)" in plan and "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_aggregate(spark):
    df = spark.createDataFrame([("1,000", "a"), ("$5", "a"), ("10%", "b"), ("oops", "b"), (None, "b")], "v string, g string")
    r = aggregate.aggregate(df, "sum", "v").first()
    assert (r.value, r.rows_processed, r.rows_skipped) == (1005.1, 3, 2)
    assert aggregate.aggregate(df, "count", "v").first().value == 5
    by = {r.g: r.value for r in aggregate.aggregate(df, "max", "v", by=["g"]).collect()}
    assert by == {"a": 1000.0, "b": 0.1}
    assert [r.sample for r in aggregate.skipped_samples(df, "v").collect()] == ["oops"]
    assert aggregate.aggregate(df.limit(0), "sum", "v").first().value is None
    median = spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int")
    assert aggregate.aggregate(median, "median", "v").first().value == 2.5


@pytest.mark.parametrize("reuse,advisory", [("true", "64m"), ("false", "64m"), ("true", "1k"), ("false", "1k")])
def test_ranks_do_not_depend_on_physical_plans(spark, reuse, advisory):
    settings = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.adaptive.coalescePartitions.minPartitionSize": advisory}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        values = [(i * 7919) % 10007 / 7 for i in range(10007)] + [3.0] * 500
        df = spark.range(len(values)).select(F.element_at(F.lit(values), (F.col("id") + 1).cast("int")).alias("v"))
        got, order = profile.quartiles(df, F.col("v")).first(), sorted(values)
        assert (got.n, got.q1, got.q3) == (len(order), order[len(order) // 4], order[3 * len(order) // 4])
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_and_cells(spark):
    df = spark.createDataFrame([(i, f"name {i}") for i in range(30)], "id int, name string")
    rows = filters.lookup(df, "NAME 1", "name", order=["id"]).collect()
    assert len(rows) == 10 and rows[0].total_matches == 11
    assert filters.cell(df, "b3", ["id"]).first().value == "name 1"
    with pytest.raises(ValueError):
        filters.cell(df, "Z3", ["id"])
    assert filters.column_letter(0) == "A" and filters.column_letter(26) == "AA"
    assert [r.id for r in filters.page(df, ["id"], 2, 10).collect()] == list(range(10, 20))


def test_compare(spark):
    df = spark.createDataFrame([("Jan", 10000.0), ("Feb", 12000.0), ("Zero", 0.0)], "m string, v double")
    r = compare.compare(df, ["v"], F.col("m") == "Feb", F.col("m") == "Jan", temporal=True).first()
    assert (r.absolute_diff, r.percentage_diff, r.trend, r.growth_rate) == (2000.0, 20.0, "increasing", 20.0)
    assert compare.compare(df, ["v"], F.col("m") == "Feb", F.col("m") == "Zero").first().percentage_diff is None
    files = spark.createDataFrame([(1, 1000.0), (1, 2000.0), (2, 1100.0), (2, 2200.0)], "f int, v double")
    second = compare.sequence_differences(files, "f", "v").where("f = 2").first()
    assert (second.mean, second.difference, second.percentage_change, second.trend) == (1650.0, 150.0, 10.0, "increasing")


def test_quartiles_by_position(spark):
    q = profile.quartiles(spark.createDataFrame([(1,), (2,), (3,), (10,)], "v int"), F.col("v")).first()
    assert (q.q1, q.q3, q.n) == (2.0, 10.0, 4)
    many = sorted([(7 * i) % 101 for i in range(1000)])
    q = profile.quartiles(spark.createDataFrame([(v,) for v in many], "v int").repartition(7), F.col("v")).first()
    assert (q.q1, q.q3) == (many[250], many[750])


def test_trend_and_sample(spark):
    df = spark.createDataFrame([(i, float(i + 1)) for i in range(5)], "i int, v double")
    r = profile.slope_trend(df, "v", "i").first()
    assert abs(r.slope - 1) < 1e-9 and abs(r.relative_slope - 1 / 3) < 1e-9 and r.trend == "increasing"
    big = spark.range(5000).withColumnRenamed("id", "i")
    got = [r.i for r in profile.sample_rows(big, "i", 5000).collect()]
    assert len(set(got)) == 100 and {0, 4999} <= set(got)


def test_profile(spark):
    df = spark.createDataFrame([("1", "a"), ("2", None), ("n/a", "b")], "n string, t string")
    rows = {r["column"]: r for r in profile.profile(df).collect()}
    assert rows["n"].kind == "number" and rows["n"].missing == 1 and rows["n"].max == 2.0 and rows["t"].kind == "text" and rows["t"]["mean"] is None


def test_anomalies(spark):
    rows = [(i, float(10 + i % 3), "x") for i in range(20)] + [(20, 1000.0, None), (21, 10.0, "x"), (22, None, "n/a")]
    df = spark.createDataFrame(rows, "i int, v double, t string")
    out = anomaly.iqr_outliers(df, "v", ["i"]).collect()
    assert [(r.i, r.severity) for r in out] == [(20, "critical")]
    assert [r.i for r in anomaly.z_outliers(df, "v", ["i"]).collect()] == [20]
    assert {(r.i, r["column"]) for r in anomaly.missing_cells(df, ["i"], ["v", "t"]).collect()} == {(20, "t"), (22, "v"), (22, "t")}
    assert [r.i for r in anomaly.empty_rows(df, "i", ["v", "t"]).collect()] == [22]
    dup = {(r.i, r.first_index) for r in anomaly.duplicate_rows(df, "i", ["v", "t"]).collect()}
    assert (3, 0) in dup and (21, 0) in dup and all(a > b for a, b in dup)
    mixed = spark.createDataFrame([(i, "5" if i else "five") for i in range(10)], "i int, v string")
    assert [(r.i, r.expected) for r in anomaly.format_drift(mixed, "v", ["i"]).collect()] == [(0, "numeric")]
    found = {r.anomaly_type: r.n for r in anomaly.report(df, "i", ["v", "t"], ["v"]).collect()}
    assert found["outlier"] == 1 and found["missing_value"] == 3 and found["empty_row"] == 1


def test_align(spark):
    assert align.common_columns(spark, [["Product Name", "Revenue"], ["product name", "Revenues"]]) == [["Product Name", "product name"], ["Revenue", "Revenues"]]
    assert align.strategy_of([["a", "b"], ["A", "B", "c"]]) == "union" and align.strategy_of([["a", "b"], ["a", "x"]]) == "join" and align.strategy_of([["a"], ["b"]]) == "separate"
    a = spark.createDataFrame([(i,) for i in range(10)], "cust_id int")
    b = spark.createDataFrame([(i, "z") for i in range(5)], "cust_id int, s string")
    r = align.relationships({"a": a, "b": b}, [("a", "cust_id", "b", "cust_id")]).first()
    assert (r.name_similarity, r.overlap, r.confidence, r.relationship, r.join_type) == (1.0, 1.0, 1.0, "primary_key", "inner")
    assert align.related_tables(align.relationships({"a": a, "b": b}, [("a", "cust_id", "b", "cust_id")]), "a").first().related == "b"


@pytest.mark.parametrize("n", [1, 49, 50, 51, 95, 96, 120, 141])
def test_chunks(spark, n):
    df = spark.range(n).select(F.lit("s").alias("sheet"), F.col("id").cast("int").alias("i"), F.col("id").cast("string").alias("t"))
    got = sorted((r.start_row, r.end_row, r.content) for r in chunks.chunk_rows(df, "sheet", "i", F.col("t")).collect())
    want, start = [], 0
    while True:
        end = min(start + 50, n)
        want.append((start, end - 1, "\n".join(map(str, range(start, end)))))
        if end == n:
            break
        start += 45
    assert got == want


def test_fusion(spark):
    sem = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "id string, score double")
    bm = spark.createDataFrame([("c", 3.0), ("a", 2.0), ("b", 1.0)], "id string, score double")
    out = retrieval.rrf([sem, bm], "id", 10).collect()
    assert [r.id for r in out] == ["a", "c", "b"] and abs(out[0].rrf - (1 / 61 + 1 / 62)) < 1e-9


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green tree here"), (4, None)], "doc_id long, text string")
    assert [r.doc_id for r in retrieval.bm25(docs.where("text is not null"), ["red"], 1).collect()] == [1]


def test_access(spark):
    df = spark.createDataFrame([(1, "x", "s")], "id int, card_number string, shipping string")
    assert tuple(access.mask(df, "viewer").first()) == (1, access.MASK, access.MASK) and tuple(access.mask(df, "admin").first()) == (1, "x", "s")
    named = spark.range(1).select(*[F.lit(1).alias(c) for c in ("cvv", "Compensation", "social security", "creditcard", "phone")])
    assert tuple(access.mask(named, "viewer").first()) == (access.MASK,) * 4 + (1,)
    grants = spark.createDataFrame([("u", "f1", "admin"), ("u", "*", "viewer"), ("w", "f1", "viewer")], "user_id string, file_id string, role string")
    asked = spark.createDataFrame([("u", "f1", "developer"), ("u", "f2", "analyst"), ("u", "f2", "viewer"), ("z", "f1", "viewer")], "user_id string, file_id string, needed string")
    got = {(r.user_id, r.file_id, r.needed): (r.role, r.allowed) for r in access.effective_roles(asked, grants).collect()}
    assert got == {("u", "f1", "developer"): ("admin", True), ("u", "f2", "analyst"): ("viewer", False), ("u", "f2", "viewer"): ("viewer", True), ("z", "f1", "viewer"): (None, False)}


def test_incremental(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("d", "h5")], "id string, hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "h3"), ("c", "h4")], "id string, hash string")
    assert {r.id: r.change for r in incremental.diff(old, new, "id").collect()} == {"a": "no_change", "b": "modified", "c": "added", "d": "removed"}
    assert [r.id for r in incremental.deleted(new, old, "id").collect()] == ["d"]
    assert {(r.id, r.hash) for r in incremental.upsert(old, new, "id").collect()} == {("a", "h1"), ("b", "h3"), ("c", "h4"), ("d", "h5")}
    exist, fresh = incremental.split_existing(old, new, "id")
    assert {r.id for r in exist.collect()} == {"a", "b"} and {r.id for r in fresh.collect()} == {"c"}


def test_stores(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, v int, t string")
    assert {(r.key, r.t) for r in stores.latest(df, "key", "v").collect()} == {("k", "new"), ("j", "only")}
    back = stores.rollback(df, "key", "k", "v", 1).first()
    assert (back.v, back.t) == (3, "old")
    ratings = spark.createDataFrame([("a", 1), ("a", 2), ("a", 1), ("b", 5), ("b", 2)], "chunk string, rating int")
    assert [tuple(r) for r in stores.flagged(ratings, "chunk", "rating").collect()] == [("a", 3)]
    cache = spark.createDataFrame([(1, ["f", "g"]), (2, ["h"]), (3, [])], "cache_key int, file_ids array<string>")
    assert {r.cache_key for r in stores.invalidate(cache, spark.createDataFrame([("g",)], "file_id string")).collect()} == {2, 3}
    assert spark.range(1).select(stores.retry_delay(F.lit(9))).first()[0] == 30.0


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "op string, v double")
    r = metrics.histogram_stats(df, "op", "v").first()
    assert (r.p50, round(r.p95, 4), r.n) == (50.5, 95.05, 100)
    assert metrics.performance(df, "op", "v", F.lit(90.0)).first().exceeded == 10
    assert sorted(r.v for r in metrics.last_n(df, "op", [F.desc("v")], 3).collect()) == [98.0, 99.0, 100.0]


def test_ranking(spark):
    files = spark.createDataFrame([("f1", "Sales_Jan2024", 0.95, 1.0), ("f2", "Cost", 0.1, 0.0)], "file_id string, file_name string, semantic double, preference double")
    scored = ranking.file_scores(files, "sales jan2024", ["jan"])
    got = {r.file_id: (r.score, r.rejected) for r in scored.collect()}
    assert got["f1"] == (1.0, False) and got["f2"] == (0.05, True) and ranking.file_decision(scored).first().action == "auto"
    sheets = spark.createDataFrame([("Sales Summary", ["Month", "Revenue"], ["numeric"], 0.5), ("Config", ["Setting"], ["text"], 0.0)], "sheet_name string, headers array<string>, data_types array<string>, content double")
    rows = {r.sheet_name: r.score for r in ranking.sheet_scores(sheets, "revenue in the sales summary", ["numeric"]).collect()}
    assert rows["Sales Summary"] > 0.7 > 0.3 > rows["Config"]


def test_questions(spark):
    asked = ["What is the total l_extendedprice where l_returnflag = A", "Compare North versus South", "Summarize the data", "Find the phone of Ann", "How many orders", "zzz"]
    rows = question.classify(spark.createDataFrame([(q,) for q in asked], "question string")).collect()
    assert [r.kind for r in rows] == ["aggregation", "comparison", "summarization", "lookup", "aggregation", "lookup"]
    assert rows[0].function == "sum" and rows[4].function == "count"
    more = question.classify(spark.createDataFrame([("total of the average column",), ("the biggest order",), ("median price",)], "question string")).collect()
    assert [r.function for r in more] == ["sum", "max", "median"]
    df = spark.createDataFrame([("North", 5.0), ("South", 3.0), ("north", 1.0)], "region string, sales double")
    assert question.answer(df, "What is the average sales by region").count() == 3
    assert question.answer(df, "total sales where sales >= 3 and region = north").first().value == 5.0
    assert question.answer(df, "Compare North versus South").first().absolute_diff == 3.0
    assert question.answer(df, "Find rows for South").count() == 1
    assert question.answer(df, "Describe the sales").first()["mean"] == 3.0


def test_filled_columns_leave_out_empty_ones(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None)], "a int, b string, `c d` string")
    assert sorted(map(tuple, align.filled_columns(df).collect())) == [("a", 2), ("c d", 1)]
    assert align.filled_columns(df.where("false")).collect() == []


def test_common_columns_of_several_tables(spark):
    headers = [["Product Name", "Revenue", "Cost"], ["product name", "Revenues"], ["Product Names", "revenue", "Profit"]]
    assert align.common_columns(spark, headers) == [["Product Name", "product name", "Product Names"], ["Revenue", "Revenues", "revenue"]]
    assert align.common_columns(spark, [["a"]]) == [["a"]]


def test_totals_of_numbers_dates_and_text(spark):
    df = spark.sql("SELECT * FROM VALUES ('1,000', DATE '2024-01-05', 'x', 2.5D), ('5', NULL, NULL, NULL), (NULL, DATE '2023-12-31', 'y', 1.5D) t(price, day, name, `odd name`)")
    rows = {r["column"]: r for r in profile.totals(df).collect()}
    assert (rows["price"]["kind"], rows["price"]["filled"], rows["price"]["total"]) == ("number", 2, 1005.0)
    assert (rows["day"]["kind"], rows["day"]["filled"], rows["day"]["total"]) == ("date", 2, None)
    assert (str(rows["day"]["first"])[:10], str(rows["day"]["last"])[:10]) == ("2023-12-31", "2024-01-05")
    assert (rows["name"]["kind"], rows["name"]["filled"]) == ("text", 0)
    assert (rows["odd name"]["total"], rows["odd name"]["mean"]) == (4.0, 2.0)
    assert [r["filled"] for r in profile.totals(df.where("false")).collect()] == [0, 0, 0, 0]
