"""Several tables together: matching columns, union, join, relationships between columns."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import columns_match, name_similarity


def match_columns(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """left_column, right_column of two header frames (column `header`) whose names are near; a stated, small
    set of names against another, so a nested-loop join is meant."""
    return left.select(F.col("header").alias("left_column")).join(F.broadcast(right.select(F.col("header").alias("right_column"))), columns_match(F.col("left_column"), F.col("right_column"), least))


def common_columns(spark: SparkSession, headers: list[list[str]], least: float = 0.85) -> list[list[str]]:
    """For each column of the first table that every other table has, its name in each table: the same but for case, else
    the first that is near. All pairs of names still open are compared in one job."""
    first, others = headers[0], headers[1:]
    found = [[next((h for h in other if h.lower() == name.lower()), None) for other in others] for name in first]
    pairs = [(i, j, k, name, h) for i, name in enumerate(first) for j, other in enumerate(others) if found[i][j] is None for k, h in enumerate(other)]
    if pairs:
        near = spark.createDataFrame(pairs, "i int, j int, k int, name string, other string").where(columns_match(F.col("name"), F.col("other"), least))
        for i, j, other in near.groupBy("i", "j").agg(F.min_by("other", "k")).collect():  # at most one row for each name and table
            found[i][j] = other
    return [[name, *names] for name, names in zip(first, found) if all(names)]


def filled_columns(df: DataFrame) -> DataFrame:
    """header and filled (cells that hold a value) of each column that has any, in one scan."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    each = [F.struct(F.lit(c).alias("header"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(df.columns)]
    return counts.select(F.inline(F.array(*each))).where("filled > 0")


def align_union(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The given columns of all tables, one below the other, with the table's name; missing ones are null."""
    parts = [d.select(*[c for c in columns if c in d.columns]).withColumn("table_name", F.lit(n)) for n, d in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def combine(left: DataFrame, right: DataFrame, strategy: str, on: list[str] | None = None, how: str = "inner") -> DataFrame:
    """union stacks by name, join joins on common columns; sizes and statistics pick the physical join."""
    if strategy == "union":
        return left.unionByName(right, allowMissingColumns=True)
    return left.join(right, on or sorted(set(left.columns) & set(right.columns)), how)


def strategy_of(headers: list[list[str]]) -> str:
    """union where over 0.7 of the first table's columns are in all others, join with any common one, else separate."""
    first = {h.lower() for h in headers[0]}
    shared = first.intersection(*[{h.lower() for h in other} for other in headers[1:]])
    return "union" if len(shared) > 0.7 * max(len(first), 1) else "join" if shared else "separate"


def column_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column, dtype, n, distinct_values, uniqueness for every column of every table."""
    parts = []
    for name, df in tables.items():
        row = df.agg(*[F.struct(F.count(F.col(c)).alias("n"), F.count_distinct(F.col(c)).alias("d")).alias(c) for c in df.columns])
        items = F.array(*[F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(c)["n"].alias("n"), F.col(c)["d"].alias("distinct_values")) for c, t in df.dtypes])
        parts.append(row.select(F.explode(items).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("uniqueness", F.coalesce(F.try_divide(F.col("distinct_values"), F.col("n")), F.lit(0.0)))


def value_overlap(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """common, distinct_left, distinct_right and overlap (common / smaller) of all values of two columns.

    Distinct values of both sides meet in one shuffle on the value; nothing is sampled or collected.
    """
    key = lambda d, c, side: d.select(F.lower(F.trim(F.col(c).cast("string"))).alias("v")).where("v is not null").distinct().withColumn(side, F.lit(1))
    met = key(left, a, "l").join(key(right, b, "r"), "v", "full_outer")
    out = met.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count("l").alias("distinct_left"), F.count("r").alias("distinct_right"))
    return out.withColumn("overlap", F.coalesce(F.try_divide(F.col("common"), F.least("distinct_left", "distinct_right")), F.lit(0.0)))


def column_pairs(tables: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """Every pair of columns of different tables, tables in the given order."""
    return [(t1, c1, t2, c2) for (t1, d1), (t2, d2) in combinations(tables.items(), 2) for c1 in d1.columns for c2 in d2.columns]


#: Types whose different values are different texts, and the type they are counted in.
_OWN = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "bigint", "float": "float", "double": "double", "date": "date", "boolean": "boolean"}


def _counted(df: DataFrame, columns: dict[int, str]) -> list[DataFrame]:
    """col, raw (as text) and n for the values of some columns, numbered; columns of one type are counted together."""
    kinds: dict[str, list[int]] = {}
    types = dict(df.dtypes)
    for i, c in columns.items():
        kinds.setdefault(_OWN.get(types[c], "string"), []).append(i)
    out = []
    for kind, own in kinds.items():
        each = [F.struct(F.lit(i).alias("col"), F.col(f"`{columns[i]}`").cast(kind).alias("value")) for i in own]
        cells = df.select(F.explode(F.array(*each)).alias("r")).select("r.*").where("value is not null")
        # grouping takes zeros for equal whose texts differ
        zero = [F.when(F.col("value") == 0, F.col("value").cast("string")).alias("zero")] if kind in ("float", "double") else []
        counts = cells.groupBy("col", "value", *zero).agg(F.count("*").alias("n"))
        raw = F.coalesce("zero", F.col("value").cast("string")) if zero else F.col("value").cast("string")
        out.append(counts.select("col", raw.alias("raw"), "n"))
    return out


def relationships(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]] | None = None, least: float = 0.5) -> DataFrame:
    """For pairs (table, column, table, column), or all pairs of columns of different tables: name similarity,
    overlap, uniqueness, confidence, type and the join that suits. Pairs under `least` confidence are left out.

    Each table's columns are read once, whatever the number of pairs: cells are counted by column and value, in the column's own type, so
    that only different values become texts; each value's columns (at most all of them) give the pairs that share it. A column
    without values overlaps with nothing."""
    spark = next(iter(tables.values())).sparkSession
    pairs = column_pairs(tables) if pairs is None else pairs
    columns = sorted({tc for t1, c1, t2, c2 in pairs for tc in ((t1, c1), (t2, c2))})
    place = {tc: i for i, tc in enumerate(columns)}
    parts = [p for name, df in tables.items() for p in _counted(df, {i: c for i, (t, c) in enumerate(columns) if t == name})]
    if not parts:
        return spark.createDataFrame([], "table_1 string, column_1 string, table_2 string, column_2 string, name_similarity double, overlap double, confidence double, relationship string, join_type string")
    counted = reduce(lambda x, y: x.unionByName(y), parts)
    # both groupings by value find their rows together
    cells = counted.withColumn("v", F.lower(F.trim("raw"))).repartition("v").groupBy("v", "col").agg(F.count("*").alias("raws"), F.sum("n").alias("n"))
    held = cells.groupBy("v").agg(F.collect_list(F.struct("col", "raws", "n")).alias("held"))
    # a column with itself (i = j) carries its own counts
    once = lambda x, y, c: F.when(x["col"] == y["col"], x[c]).otherwise(F.lit(0).cast("bigint"))
    met = F.transform("held", lambda x: F.transform(F.filter("held", lambda y: y["col"] >= x["col"]), lambda y: F.struct(x["col"].alias("i"), y["col"].alias("j"), F.lit(1).cast("bigint").alias("common"), once(x, y, "raws").alias("raws"), once(x, y, "n").alias("n"))))
    met = held.select(F.explode(F.flatten(met)).alias("r")).select("r.*")
    ends = [(*sorted((place[p[:2]], place[p[2:]])), place[p[:2]], place[p[2:]]) for p in map(tuple, pairs)]
    wanted = sorted({(i, j) for i, j, _, _ in ends} | {(i, i) for i in range(len(columns))})
    zero = spark.createDataFrame([(i, j, 0, 0, 0) for i, j in wanted], "i int, j int, common bigint, raws bigint, n bigint")
    met = met.unionByName(zero).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("common", "raws", "n")])
    # one row for each pair of columns is left: each end's own counts reach its pairs
    own = F.col("i") == F.col("j")
    for k in ("i", "j"):
        met = met.withColumns({f"{c}_{k}": F.max(F.when(own, F.col(c))).over(Window.partitionBy(k)) for c in ("common", "raws", "n")})
    whole = met.select("i", "j", F.coalesce(F.try_divide("common", F.least("common_i", "common_j")), F.lit(0.0)).alias("overlap"), F.try_divide("raws_i", "n_i").alias("u_i"), F.try_divide("raws_j", "n_j").alias("u_j"))
    types = {name: dict(df.dtypes) for name, df in tables.items()}
    names = [(i, j, first > second, *p, types[p[0]][p[1]] == types[p[2]][p[3]]) for (i, j, first, second), p in zip(ends, pairs)]
    named = spark.createDataFrame(names, "i int, j int, turned boolean, table_1 string, column_1 string, table_2 string, column_2 string, same_type boolean")
    out = named.join(whole, ["i", "j"]).withColumn("name_similarity", name_similarity(F.col("column_1"), F.col("column_2")))
    out = out.withColumns({"u1": F.when(F.col("turned"), F.col("u_j")).otherwise(F.col("u_i")), "u2": F.when(F.col("turned"), F.col("u_i")).otherwise(F.col("u_j"))})
    keyish = lambda c: F.lower(c).rlike("(id|key|code|no)$")
    base = 0.4 * F.col("name_similarity") + 0.4 * F.col("overlap") + F.when(keyish(F.col("column_1")) & keyish(F.col("column_2")), 0.15).otherwise(0.0) + F.when(F.col("same_type"), 0.05).otherwise(0.0)
    out = out.withColumn("confidence", F.round(F.when((F.col("u1") < 0.1) & (F.col("u2") < 0.1), base * 0.7).otherwise(base), 6))
    kind = F.when((F.col("u1") > 0.95) & (F.col("u2") > 0.95), "primary_key").when((F.col("u1") > 0.95) | (F.col("u2") > 0.95), "foreign_key").when(F.col("name_similarity") > 0.8, "common_column").otherwise("lookup")
    join = F.when(F.col("overlap") > 0.8, "inner").when(F.col("overlap") > 0.5, "left").otherwise("full")
    return out.where(F.col("confidence") >= least).select("table_1", "column_1", "table_2", "column_2", F.round("name_similarity", 6).alias("name_similarity"), F.round("overlap", 6).alias("overlap"), "confidence", kind.alias("relationship"), join.alias("join_type"))


def related_tables(found: DataFrame, table_name: str) -> DataFrame:
    """Other tables by relevance: min(1, mean confidence x (1 + 0.1 x relationships))."""
    both = found.select(F.col("table_1").alias("a"), F.col("table_2").alias("b"), "confidence").unionByName(found.select(F.col("table_2").alias("a"), F.col("table_1").alias("b"), "confidence"))
    out = both.where(F.col("a") == table_name).groupBy(F.col("b").alias("related")).agg(F.avg("confidence").alias("c"), F.count("*").alias("n"))
    return out.select("related", "n", F.round(F.least(F.lit(1.0), F.col("c") * (1 + 0.1 * F.col("n"))), 6).alias("relevance"))
