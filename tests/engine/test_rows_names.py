"""Row numbers and slices, and nearly alike names against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import filters, names, rows

SF = "/root/testdata/sf0.001"


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def match(a: str, b: str, distance=3, least=0.8) -> bool:
    d = edit_distance(a.lower(), b.lower())
    return d <= distance or 1 - d / max(len(a), len(b)) >= least


def spellings(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefg hij") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 7, 9, 12, 16, 22, 31, 45]))) for _ in range(n // 4)]
    out = []
    for _ in range(n):
        name = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            at = rng.randrange(len(name) + 1)
            edit = rng.randrange(3)
            if edit == 0:
                name.insert(at, rng.choice("abcXYZ"))
            elif name and at < len(name):
                name[at : at + 1] = [] if edit == 1 else [rng.choice("abcXYZ")]
        out.append("".join(name))
    return out


@pytest.mark.parametrize("distance, least", [(3, 0.8), (1, 0.85), (0, 0.7)])
def test_near_names_equal_all_pairs(spark, distance, least):
    left, right = spellings(160, 1), spellings(160, 2) + spellings(40, 1)
    frame = lambda v: spark.createDataFrame([(x,) for x in v] + [(None,)], "name string")
    found = names.near_names(frame(left), frame(right), distance, least)
    want = {(a.lower(), b.lower()) for a in left for b in right if a.lower() == b.lower() or (not a and not b) or match(a or "", b or "", distance, least)}
    assert {(r.left_name, r.right_name) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def loop(found: list[str]) -> list[str]:
    groups, out = [], []
    for name in found:
        group = next((g for g in groups if g.lower() == name.lower() or match(name, g)), None)
        if group is None:
            groups.append(name)
        out.append(group if group is not None else name)
    return out


@pytest.mark.parametrize("first", [16, 4096])
def test_groups_equal_the_loop(spark, first):
    found = [n for n in spellings(400, 5) if n]
    df = spark.createDataFrame(list(enumerate(found)), "at int, sheet string").repartition(5)
    grouped = names.group_names(df, "sheet", ["at"], first=first)
    assert [r.group_name for r in grouped.orderBy("at").collect()] == loop(found)


def test_groups_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "Sales"), (3, "SALES"), (4, None), (5, "Inventory list")], "at int, sheet string")
    assert [r.group_name for r in names.group_names(df, "sheet", ["at"]).orderBy("at").collect()] == [None, "Sales", "Sales", None, "Inventory list"]
    assert names.group_names(df.limit(0), "sheet", ["at"]).count() == 0


def test_row_index(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), F.col("id"))
    index = rows.RowIndex.build(df, ["k"], 8)
    assert index.count() == 5000
    assert all(r.k == r.row_idx for r in index.frame().collect())
    for offset, size in [(0, 1), (4999, 1), (1234, 3000), (5000, 5), (4990, 100)]:
        got = index.slice(offset, size)
        assert [r.k for r in got.collect()] == list(range(offset, min(offset + size, 5000)))
    assert len(index.slice(3000, 1).inputFiles()) == 8  # before pruning
    scan = index.slice(3000, 1)
    scan.collect()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_part" in plan.replace("#", "").replace("isnotnull(_part", "[_part") or "_part" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert rows.RowIndex.build(df.limit(0), ["k"]).frame().count() == 0


def test_deep_cell_reads_one_partition(spark, monkeypatch):
    monkeypatch.setattr(rows, "SHALLOW", 100)
    df = spark.range(0, 20_000, 1, 6).select(F.col("id"), F.concat(F.lit("row "), "id").alias("name"))
    found = filters.cell(df, "B15002", ["id"])
    assert found.first().value == "row 15000"
    assert filters.cell(df, "B30000", ["id"]).count() == 0
    assert [r.id for r in filters.page(df, ["id"], 900, 20).collect()] == list(range(17_980, 18_000))


def test_page_after_walks_all_rows(spark):
    rng = random.Random(1)
    data = sorted({(rng.randrange(20), rng.randrange(1000)) for _ in range(300)})
    df = spark.createDataFrame(data, "a int, b int").repartition(4)
    seen, last = [], None
    while page := rows.page_after(df, ["a", "b"], last, 47).collect():
        seen += [tuple(r) for r in page]
        last = list(page[-1])
    assert seen == data


def test_side_by_side(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(9,), (8,), (7,)], "k int")
    got = rows.side_by_side({"a": a, "b": b}, {"a": ["k"], "b": [F.desc("k")]}, ["k", "v"]).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, 1, "y", 9, None), (1, 3, "x", 8, None), (2, None, None, 7, None)]


def test_edits_in_bytes(spark):
    """An accent is one character but two bytes; SQL engines may count either."""
    left = spark.createDataFrame([("éa êb",), ("plain",)], "name string")
    right = spark.createDataFrame([("ea eb",), ("plàin",)], "name string")
    found = lambda **k: sorted(tuple(r) for r in names.near_names(left, right, **k).collect())
    assert found() == [("plain", "plàin", 1), ("éa êb", "ea eb", 2)]
    assert found(in_bytes=True) == [("plain", "plàin", 2)]
    df = spark.createDataFrame([(1, "éa êb"), (2, "ea eb"), (3, "ea ec")], "at int, sheet string")
    assert [r.group_name for r in names.group_names(df, "sheet", ["at"], in_bytes=True).orderBy("at").collect()] == ["éa êb", "ea eb", "ea eb"]


def test_few_edits_change_few_marks():
    found = spellings(300, 7)
    for a, b in zip(found, found[1:] + found[:1]):
        differ = int.from_bytes(names._mark(a), "little") ^ int.from_bytes(names._mark(b), "little")
        assert differ.bit_count() <= 4 * edit_distance(a, b) - abs(len(a) - len(b))


def test_names_are_compared_by_all_tasks(spark):
    df = spark.createDataFrame([(n,) for n in spellings(200, 3)], "name string")
    assert names._marked(df.distinct()).rdd.getNumPartitions() == 4


def test_names_cut_up_are_not_broadcast(spark):
    """A few names by size, hundreds of rows each once cut up: neither side may go through the driver."""
    frame = lambda seed: spark.createDataFrame([(n,) for n in spellings(200, seed)], "name string")
    found = names.near_names(frame(3), frame(4))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()  # the one that ran
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "SortMergeJoin" in plan


def test_names_compared_with_themselves_are_not_broadcast(spark):
    """The step that groups take, with marks compared before edits are counted."""
    marked = names._marked(spark.createDataFrame([(n,) for n in spellings(200, 3)], "name string").distinct())
    found = names._met(marked, marked, 3, 0.8, True)
    assert {(r.shorter, r.longer) for r in found.collect() if r.shorter != r.longer}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan
    condition = next(line for line in plan.splitlines() if "SortMergeJoin" in line)
    assert condition.index("bit_count") < condition.index("levenshtein")


def test_few_edits_change_few_letters():
    found = spellings(300, 7)
    for a, b in zip(found, found[1:] + found[:1]):
        assert (names._letters(a) ^ names._letters(b)).bit_count() <= 2 * edit_distance(a, b) - abs(len(a) - len(b))
