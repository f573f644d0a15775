"""The stored table's merges, and the posting index against scores of every document."""

import re
import os
import random

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import postings, retrieval, stored

SF = "/root/testdata/sf0.001"


def table_of(spark, path, rows, buckets=8):
    df = spark.createDataFrame(rows, "k int, v string, at int")
    table = stored.StoredTable.create(spark, str(path), df.schema, ["k"], buckets)
    table.merge(df)
    return table


def content(df):
    return sorted(map(tuple, df.collect()))


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", [(i, f"v{i}", 0) for i in range(200)])
    before = table.snapshot()
    assert len(before.buckets) == 8
    updates = spark.createDataFrame([(3, "new", 1), (3, "newest", 2), (3, "old", 0), (7, "gone", 1), (500, "added", 1)], "k int, v string, at int")
    after = table.merge(updates, order="at", deleted=F.col("v") == "gone")
    rows = {k: v for k, v, _ in content(table.read())}
    assert rows[3] == "newest" and 7 not in rows and rows[500] == "added" and len(rows) == 200
    changed = {b for b in after.buckets if after.buckets[b] != before.buckets[b]}
    assert 1 <= len(changed) <= 3
    assert content(table.read(before.number)) == sorted((i, f"v{i}", 0) for i in range(200))
    assert content(table.lookup(spark.createDataFrame([(3,), (7,), (8,)], "k int"))) == [(3, "newest", 2), (8, "v8", 0)]
    assert len(table.lookup(spark.createDataFrame([(8,)], "k int")).inputFiles()) <= 2
    assert table.vacuum() > 0 and len(content(table.read())) == 200


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", [(1, "a", 0)])
    batch = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "k int, v string, at int")
    first = table.merge(batch, writer="w", batch=0)
    again = table.merge(spark.createDataFrame([(1, "other", 9)], "k int, v string, at int"), writer="w", batch=0)
    assert again == first and content(table.read()) == [(1, "b", 1), (2, "c", 1)]
    table.merge(batch.limit(0), writer="w", batch=1)
    assert table.snapshot().batches == {"w": 1}
    assert table.merge(batch.limit(0)).number == table.snapshot().number


def test_failures_leave_the_snapshot(spark, tmp_path):
    table = table_of(spark, tmp_path / "t", [(1, "a", 0)])
    with pytest.raises(ValueError, match="key"):
        table.merge(spark.createDataFrame([(None, "x", 1)], "k int, v string, at int"))
    broken = spark.createDataFrame([(1, "x", 1)], "k int, v string, at int").withColumn("v", F.raise_error("stop"))
    with pytest.raises(Exception, match="stop"):
        table.merge(broken)
    assert content(table.read()) == [(1, "a", 0)]
    other = stored.StoredTable(spark, table.path)
    stale = other.snapshot()
    table.merge(spark.createDataFrame([(2, "b", 0)], "k int, v string, at int"))
    with pytest.raises(stored.ConcurrentMerge):
        other._commit(stored.Snapshot(stale.number + 1, ["k"], 8, stale.schema))
    with pytest.raises(FileExistsError):
        stored.StoredTable.create(spark, table.path, table.read().schema, ["k"])


def test_stream_into_table_with_replay(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(40), f"v{i}", i) for i in range(300)]
    spark.createDataFrame(rows, "k int, v string, at int").repartition(6).write.parquet(f"{tmp_path}/in")
    table = stored.StoredTable.create(spark, f"{tmp_path}/t", spark.read.parquet(f"{tmp_path}/in").schema, ["k"], 4)
    calls = []

    def run(checkpoint):
        write = table.stream_writer("s", "at")

        def twice(batch, number):  # a batch that fails after its commit comes again
            calls.append(number)
            write(batch, number)
            write(batch, number)

        stream = spark.readStream.schema("k int, v string, at int").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{tmp_path}/{checkpoint}").trigger(availableNow=True).start().awaitTermination(120)

    run("c1")
    once = content(table.read())
    number = table.snapshot().number
    assert len(calls) == 3 and number == 3
    run("c2")  # a lost checkpoint: the same batches under the same numbers
    assert table.snapshot().number == number and content(table.read()) == once
    assert {k for k, *_ in once} == {k for k, *_ in rows}


def test_postings_equal_scoring_every_document(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = postings.PostingIndex.build(docs, f"{tmp_path}/i")
    for terms, k in [(["the", "and", "thing", "moron", "des"], 20), (["worthless"], 5), (["the"], 30), (["nosuchword"], 7), (["the", "of", "and"], 150), (["de", "la", "que"], 10)]:
        got = [tuple(r) for r in index.search(terms, k).collect()]
        assert got == [tuple(r) for r in retrieval.bm25(docs, terms, k).collect()], terms


def test_postings_prune_terms_and_skip_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(["rare"] * (i % 997 == 0) * 3 + ["common"] * rng.randrange(3) + [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = postings.PostingIndex.build(docs, f"{tmp_path}/i")
    weights = index.weights(["rare", "common"])
    bounds = {r.block: r.bound for r in index.bounds(weights).collect()}
    scores = index._scores(weights, F.lit(True)).join(spark.read.parquet(f"{index.path}/documents"), "id")
    assert all(r.score <= bounds[r.block] + 1e-9 for r in scores.collect())
    plan = index._scores(weights, F.col("block").isin(1))._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [common,rare])" in plan and "EqualTo(block,1)" in plan
    want = [tuple(r) for r in retrieval.bm25(docs, ["rare", "common"], 5).collect()]
    assert [tuple(r) for r in index.search(["rare", "common"], 5).collect()] == want
    assert sum(b >= want[-1][1] for b in bounds.values()) < len(bounds)  # blocks that need no reading


def test_stored_index_is_found_again(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    first = postings.PostingIndex.stored(spark.read.parquet(f"{tmp_path}/d"))
    stamp = os.stat(f"{first.path}/terms/_SUCCESS").st_mtime_ns
    again = postings.PostingIndex.stored(spark.read.parquet(f"{tmp_path}/d"))
    assert again.path == first.path and os.stat(f"{again.path}/terms/_SUCCESS").st_mtime_ns == stamp
    assert [r.doc_id for r in again.search(["c"], 3).collect()] == [2, 1, 3]
    spark.createDataFrame([(4, "c")], "doc_id long, text string").write.mode("append").parquet(f"{tmp_path}/d")
    assert postings.PostingIndex.stored(spark.read.parquet(f"{tmp_path}/d")).path != first.path


def test_postings_come_from_texts_counted_in_place(spark, tmp_path):
    """every word of every text was shuffled."""
    rows_ = [(i, " ".join(f"w{(i * k) % 7}" for k in range(i % 9))) for i in range(700)] + [(700, None), (701, "a b A\tä\nÄ")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    assert "Exchange" not in postings._tokens(docs.coalesce(1), "doc_id", "text")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    index = postings.PostingIndex.build(docs, f"{tmp_path}/i")
    held = {(r.term, p.ids): (p.counts, p.lengths) for r in index.postings().select("term", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("p")).collect() for p in [r.p]}
    want = {(w, i): (words.count(w), len(words)) for i, text in rows_ for words in [[w for w in re.split(r"[ \t\n]+", (text or "").lower()) if w]] for w in words}
    assert held == want
    placed = spark.read.parquet(f"{tmp_path}/i/documents")
    assert placed.count() == 702 and placed.groupBy("block").count().agg(F.max("count")).first()[0] <= postings.BLOCK
