"""One-bit search against brute force; its bounds; rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.llm import one_bit

from .helpers import SF


def brute(rows, is_query, k=20):
    """{(id, vector): [(id, score), ...]} for every query row."""
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for qid, q in rows:
        if is_query(qid):
            scores = [(-float((np.array(q) * np.array(v)).sum()), i) for i, v in rows if i != qid and len(v) == len(q)]
            out[qid, q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def check(found, want, recall=0.9):
    got: dict = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for (qid, _), right in want.items():
        mine = got.get(qid, [])
        assert len(mine) == len(right) and [r for r, *_ in mine] == list(range(1, len(right) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        scores = dict(right)
        assert all(s == scores.get(i, s) for _, i, s in mine)
        hit += len(scores.keys() & {i for _, i, _ in mine})
        total += len(right)
    assert hit >= recall * total
    return hit / max(total, 1)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert check(one_bit.op13_one_bit(spark, SF), brute(rows, lambda i: i % 20 == 0)) >= 0.99


def test_larger_table_with_cells(spark, monkeypatch):
    monkeypatch.setattr(one_bit, "CELL", 200)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 40))
    x = centres[rng.integers(0, 12, 4000)] * rng.uniform(0.5, 2, (4000, 1)) + rng.standard_normal((4000, 40)) * 0.6
    x[1000:1600] = x[17]  # copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    check(one_bit.nearest(df, F.col("vec_id") % 40 == 0), brute(rows, lambda i: i % 40 == 0), 0.95)


def test_ties_awkward_rows_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(1, 70)]
    rows += [(100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [nan, 1.0]), (105, [inf, 1.0]), (None, [1.0, 1.0])]
    rows += [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (200, [1.0, 2.0, 3.0]), (201, [3.0, 2.0, 1.0]), (220, [5.0])]
    rows = [r for r in rows if r[0] != 20 or r[1] == [1.0, 2.0]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    want = brute(rows, lambda i: i % 20 == 0)
    assert check(one_bit.nearest(df, F.col("vec_id") % 20 == 0), want, 1.0) == 1.0
    got = one_bit.nearest(df, F.col("vec_id") % 20 == 0).where("query_id = 40").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == want[40, (1.0, 1.0)]


def test_empty_table(spark):
    assert one_bit.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


@pytest.mark.parametrize("size", [16, 64, 100])
def test_bounds_hold(size):
    rng = np.random.default_rng(size)
    x, q = rng.standard_normal((3000, size)), rng.standard_normal((50, size))
    centre = rng.standard_normal(size) * 0.3
    low, high = one_bit.bounds(q, centre, *one_bit.encode(x - centre), 3.0)
    true = q @ x.T
    assert ((low <= true) & (true <= high)).mean() > 0.995
    assert np.corrcoef(((low + high) / 2).ravel(), true.ravel())[0, 1] > 0.75
