"""Stored vector lists against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.operators import retrieval, vector_lists

SF = "/root/testdata/sf0.01"


def recall(found, exact) -> float:
    got, want = ([r.vec_id for r in d.collect()] for d in (found, exact))
    return len(set(got) & set(want)) / len(want)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """20,000 vectors of uneven clusters."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    x = centres[np.minimum(rng.zipf(1.4, 20_000) - 1, 59)] + rng.standard_normal((20_000, 32)) * 0.5
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)]
    path = str(tmp_path_factory.mktemp("v"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.mode("overwrite").parquet(f"{path}/t")
    df = spark.read.parquet(f"{path}/t")
    return df, vector_lists.VectorLists.build(df, f"{path}/i"), x


def test_recall_and_pruning(spark, table):
    df, index, x = table
    rates = [recall(index.search(x[i].tolist(), 10), retrieval.vector_topk(df, x[i].tolist(), 10)) for i in range(0, 20_000, 2500)]
    assert np.mean(rates) >= 0.95
    lists = len(index.model.centroids)
    assert lists == 20 and index.model.probes < lists
    plan = index.search(x[0].tolist(), 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_list" in plan
    scan = index.lists().where(F.col("_list").isin([1, 2]))
    assert scan.count() < df.count() / 2


def test_filter_and_more_probes(spark, table):
    df, index, x = table
    where = F.col("label") == 3
    exact = retrieval.vector_topk(df, x[7].tolist(), 10, where)
    assert recall(index.search(x[7].tolist(), 10, where, probes=20, refine=50), exact) == 1.0


def test_embeddings(spark, tmp_path):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    index = vector_lists.VectorLists.build(df, f"{tmp_path}/i")
    asked = df.where("vec_id % 50 = 0").collect()
    rates = [recall(index.search(list(r.embedding), 10), retrieval.vector_topk(df, list(r.embedding), 10)) for r in asked]
    assert np.mean(rates) >= 0.95


def test_awkward_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 0.0]), (5, [0.5, 0.5, 0.0]), (6, [1.0, 2.0]), (7, [1.0, None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    index = vector_lists.VectorLists.build(df, f"{tmp_path}/i")
    assert [(r.vec_id, r.score) for r in index.search([1.0, 0.0, 0.0], 3).collect()] == [(1, 1.0), (5, 0.707107)]
