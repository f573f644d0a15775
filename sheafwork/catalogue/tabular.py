"""Aggregation, filters, lookup, comparison, several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, aggregate, align, compare, filters, ranking, rows
from ..plans import question

QUERIES: dict[str, tuple] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, table: str, sql: str | None = None, into: dict = QUERIES):
    """A query over one table (given as `df`), or over several by name where `table` is ''."""

    def wrap(f):
        into[name] = ((lambda s, d: f(read(s, d, table))) if table else (lambda s, d: f(lambda n: read(s, d, n))), sql)
        return f

    return wrap


def _agg(function: str, column: str, expr: str, places: int = 4) -> None:
    sql = f"SELECT '{function}' AS aggregation, '{column}' AS target_column, round(CAST({expr} AS DOUBLE), {places}) AS value, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_skipped FROM lineitem"
    register(f"agg_{function}", "lineitem", sql)(lambda df: aggregate.aggregate(df, function, column).withColumn("value", F.round("value", places)))


_agg("sum", "l_extendedprice", "sum(l_extendedprice)", 2)
_agg("average", "l_quantity", "avg(l_quantity)")
_agg("count", "l_orderkey", "count(*)")
_agg("min", "l_extendedprice", "min(l_extendedprice)")
_agg("max", "l_extendedprice", "max(l_extendedprice)")
_agg("median", "l_extendedprice", "median(l_extendedprice)")


@register("agg_question", "lineitem", "SELECT 'sum' AS aggregation, 'l_extendedprice' AS target_column, round(sum(l_extendedprice), 2) AS value, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_skipped FROM lineitem WHERE lower(l_returnflag) = 'a'")
def agg_question(df):
    return question.answer(df, "What is the total l_extendedprice where l_returnflag = A").withColumn("value", F.round("value", 2))


@register("agg_filtered_numeric", "lineitem", "SELECT 'average' AS aggregation, 'l_discount' AS target_column, round(avg(l_discount), 6) AS value, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_skipped FROM lineitem WHERE l_quantity >= 30 AND l_tax < 0.05")
def agg_filtered_numeric(df):
    return aggregate.aggregate(df, "average", "l_discount", [("l_quantity", ">=", 30), ("l_tax", "<", 0.05)]).withColumn("value", F.round("value", 6))


@register("agg_filtered_string", "orders", "SELECT 'sum' AS aggregation, 'o_totalprice' AS target_column, round(sum(o_totalprice), 2) AS value, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_skipped FROM orders WHERE lower(o_orderstatus) != 'f' AND contains(lower(o_orderpriority), 'urgent')")
def agg_filtered_string(df):
    return aggregate.aggregate(df, "sum", "o_totalprice", [("o_orderstatus", "!=", "F"), ("o_orderpriority", "contains", "urgent")]).withColumn("value", F.round("value", 2))


@register("agg_by_group", "lineitem", "SELECT l_returnflag, 'average' AS aggregation, 'l_extendedprice' AS target_column, round(avg(l_extendedprice), 4) AS value, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_skipped FROM lineitem GROUP BY l_returnflag")
def agg_by_group(df):
    return question.answer(df, "What is the average l_extendedprice by l_returnflag").withColumn("value", F.round("value", 4))


@register("agg_coerced_text", "part", "SELECT 'sum' AS aggregation, 'price' AS target_column, round(sum(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END), 2) AS value, count(CASE WHEN p_size % 5 = 0 THEN NULL ELSE 1 END) AS rows_processed, count(CASE WHEN p_size % 5 = 0 THEN 1 END) AS rows_skipped FROM part")
def agg_coerced_text(df):
    """Prices as text with signs and separators; every fifth size isn't a number."""
    text = F.when(F.col("p_size") % 5 == 0, "n/k").otherwise(F.concat(F.lit(" $"), F.format_number("p_retailprice", 2)))
    return aggregate.aggregate(df.select(text.alias("price")), "sum", "price").withColumn("value", F.round("value", 2))


_SHARE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE TRY_CAST({c} AS DOUBLE) IS NOT NULL) / CAST(count(*) AS DOUBLE) AS share FROM customer"
    for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
)


@register("numeric_share", "customer", _SHARE)
def numeric_share(df):
    return aggregate.numeric_share(df).withColumn("share", F.col("share").cast("double"))


@register("filter_contains", "part", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), 'promo')")
def filter_contains(df):
    return filters.apply_filters(df, [filters.parse_filter("p_type promo", df.columns)]).select("p_partkey", "p_name")


@register("filter_null_law", "orders", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders) t WHERE status <> 'F'")
def filter_null_law(df):
    nulled = df.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    return filters.apply_filters(nulled, [("status", "!=", "f")]).select("o_orderkey")


@register("filter_dates", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-03-01' AND o_totalprice > 1000.5")
def filter_dates(df):
    return filters.apply_filters(df, [("o_orderdate", ">=", "1998-01-01"), ("o_orderdate", "<", "1998-03-01"), filters.parse_filter("o_totalprice > 1000.5", df.columns)]).select("o_orderkey", "o_totalprice")


@register("lookup_rows", "customer", "SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM customer WHERE starts_with(lower(trim(c_mktsegment)), 'b')) AS total_matches FROM customer WHERE starts_with(lower(trim(c_mktsegment)), 'b') ORDER BY c_custkey LIMIT 10")
def lookup_rows(df):
    return filters.lookup(df, "B", "c_mktsegment", "starts_with", order=["c_custkey"]).select("c_custkey", "c_name", "c_mktsegment", "total_matches")


@register("lookup_any_column", "part", "SELECT p_partkey, p_brand, (SELECT count(*) FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_brand), '12') OR contains(lower(p_type), '12')) AS total_matches FROM part WHERE contains(lower(p_name), '12') OR contains(lower(p_brand), '12') OR contains(lower(p_type), '12') ORDER BY p_partkey LIMIT 10")
def lookup_any_column(df):
    """Three text columns searched, the key only shown."""
    hits = filters.lookup(df.select("p_name", "p_brand", "p_type"), "12", limit=1).select("total_matches")
    any_ = None
    for c in ("p_name", "p_brand", "p_type"):
        test = filters.matches(F.col(c), "12", "contains")
        any_ = test if any_ is None else any_ | test
    return df.where(any_).orderBy("p_partkey").limit(10).select("p_partkey", "p_brand").join(F.broadcast(hits))


@register("lookup_cell_ref", "customer", "SELECT 'B10' AS cell, 'c_name' AS \"column\", c_name AS value FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 8")
def lookup_cell_ref(df):
    return filters.cell(df, "B10", ["c_custkey"])


@register("page_rows", "supplier", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 20")
def page_rows(df):
    return filters.page(df, [F.desc("s_acctbal"), "s_suppkey"], 2).select("s_suppkey", "s_name")


_COMPARE = """WITH s AS (SELECT sum(CASE WHEN {a} THEN o_totalprice END) AS a, sum(CASE WHEN {b} THEN o_totalprice END) AS b FROM orders)
SELECT 'o_totalprice' AS metric, round(a, 2) AS value_a, round(b, 2) AS value_b, round(a - b, 2) AS absolute_diff, round((a - b) / abs(b) * 100, 2) AS percentage_diff,
CASE WHEN a > b THEN 'increasing' WHEN a < b THEN 'decreasing' ELSE 'stable' END AS trend FROM s"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 2) for c in ("value_a", "value_b", "absolute_diff")})


@register("compare_periods", "orders", _COMPARE.format(a="year(o_orderdate) = 1998", b="year(o_orderdate) = 1997"))
def compare_periods(df):
    year = F.year("o_orderdate")
    return _rounded(compare.compare(df, ["o_totalprice"], year == 1998, year == 1997))


@register("compare_categories", "orders", _COMPARE.format(a="lower(o_orderstatus) = 'o'", b="lower(o_orderstatus) = 'f'"))
def compare_categories(df):
    status = F.lower("o_orderstatus")
    return _rounded(compare.compare(df, ["o_totalprice"], status == "o", status == "f"))


@register("compare_halves", "customer", "WITH s AS (SELECT sum(CASE WHEN i < n // 2 THEN c_acctbal END) AS a, sum(CASE WHEN i >= n // 2 THEN c_acctbal END) AS b FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) r) SELECT 'c_acctbal' AS metric, round(a, 2) AS value_a, round(b, 2) AS value_b, round(a - b, 2) AS absolute_diff, round((a - b) / abs(b) * 100, 2) AS percentage_diff, CASE WHEN a > b THEN 'increasing' WHEN a < b THEN 'decreasing' ELSE 'stable' END AS trend FROM s")
def compare_halves(df):
    index = rows.RowIndex.build(df, ["c_custkey"])
    a, b = compare.halves(index.frame(), "row_idx", index.count())
    return _rounded(compare.compare(index.frame(), ["c_acctbal"], a, b))


@register("compare_modes", "orders", "WITH c AS (SELECT CASE WHEN year(o_orderdate) = 1996 THEN 'a' ELSE 'b' END AS entity, o_orderpriority AS value, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY ALL), t AS (SELECT entity, max(n) AS top FROM c GROUP BY entity) SELECT c.entity, min(value) AS value, max(n) AS occurrences FROM c JOIN t ON c.entity = t.entity AND c.n = t.top GROUP BY c.entity")
def compare_modes(df):
    year = F.year("o_orderdate")
    return compare.compare_modes(df, "o_orderpriority", year == 1996, year == 1997)


@register("comparison_summary", "lineitem", "WITH s AS (SELECT sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) - sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS q, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) - sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS p, sum(CASE WHEN l_returnflag = 'A' THEN l_tax END) - sum(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS t FROM lineitem), u AS (SELECT 'l_quantity' AS m, q AS d FROM s UNION ALL SELECT 'l_extendedprice', p FROM s UNION ALL SELECT 'l_tax', t FROM s) SELECT count(*) FILTER (d > 0) AS increasing, count(*) FILTER (d < 0) AS decreasing, count(*) FILTER (d = 0) AS stable, max_by(m, d) FILTER (d > 0) AS largest_increase, min_by(m, d) FILTER (d < 0) AS largest_decrease FROM u")
def comparison_summary(df):
    flag = F.col("l_returnflag")
    return compare.comparison_summary(compare.compare(df, ["l_quantity", "l_extendedprice", "l_tax"], flag == "A", flag == "R"))


_MONTHS = """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, avg(o_totalprice) AS mean FROM orders GROUP BY 1), l AS (SELECT month, mean, lag(mean) OVER (ORDER BY month) AS previous FROM m),
d AS (SELECT *, mean - previous AS difference, CASE WHEN abs(previous) < 0.01 THEN CASE WHEN abs(mean) < 0.01 THEN 0.0 END ELSE round((mean - previous) / abs(previous) * 100, 2) END AS percentage_change FROM l) """


def _monthly(df):
    return compare.sequence_differences(df.withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), "month", "o_totalprice")


@register("trend_differences", "orders", _MONTHS + "SELECT month, round(mean, 4) AS mean, round(previous, 4) AS previous, round(difference, 4) AS difference, percentage_change, CASE WHEN percentage_change IS NULL THEN 'unknown' WHEN percentage_change > 5 THEN 'increasing' WHEN percentage_change < -5 THEN 'decreasing' ELSE 'stable' END AS trend FROM d")
def trend_differences(df):
    return _monthly(df).withColumns({c: F.round(c, 4) for c in ("mean", "previous", "difference")})


@register("trend_majority", "orders", _MONTHS + "SELECT CASE WHEN percentage_change IS NULL THEN 'unknown' WHEN percentage_change > 5 THEN 'increasing' WHEN percentage_change < -5 THEN 'decreasing' ELSE 'stable' END AS trend, count(*) AS n FROM d WHERE previous IS NOT NULL GROUP BY 1 ORDER BY n DESC, trend LIMIT 1")
def trend_majority(df):
    return compare.majority_trend(_monthly(df))


@register("key_differences", "orders", _MONTHS + "SELECT month, round(difference, 4) AS difference, percentage_change FROM d WHERE difference IS NOT NULL ORDER BY abs(difference) DESC, month LIMIT 5")
def key_differences(df):
    return compare.key_differences(_monthly(df), "month").withColumn("difference", F.round("difference", 4))


@register("align_union", "", "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus, 'y1996' AS table_name FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'y1997' FROM orders WHERE year(o_orderdate) = 1997")
def align_union(read_):
    orders = read_("orders")
    y = F.year("o_orderdate")
    return align.align_union({"y1996": orders.where(y == 1996).drop("o_orderstatus"), "y1997": orders.where(y == 1997)}, ["o_orderkey", "o_totalprice", "o_orderstatus"]).select("o_orderkey", "o_totalprice", "o_orderstatus", "table_name")


@register("combine_join", "", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def combine_join(read_):
    joined = align.combine(read_("customer").withColumnRenamed("c_nationkey", "nationkey"), read_("nation").withColumnRenamed("n_nationkey", "nationkey"), "join")
    return joined.groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register("combine_union", "", "SELECT name, nationkey, acctbal FROM (SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier) t WHERE acctbal < 0")
def combine_union(read_):
    c = read_("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"))
    s = read_("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return align.combine(c, s, "union").where("acctbal < 0")


_PAIRS = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("part", "p_size", "nation", "n_nationkey")]


def _tables(read_):
    return {t: read_(t) for t in ("orders", "customer", "nation", "region", "lineitem", "part")}


def _pair_sql(t1, c1, t2, c2):
    return f"""SELECT '{t1}' AS table_1, '{c1}' AS column_1, '{t2}' AS table_2, '{c2}' AS column_2,
CASE WHEN lower('{c1}') = lower('{c2}') THEN 1.0 WHEN rtrim('{c1}', '_id') = rtrim('{c2}', '_id') THEN 0.95 ELSE (len(list_intersect(list_distinct(string_split('{c1}', '')), list_distinct(string_split('{c2}', '')))) / CAST(len(list_distinct(list_concat(string_split('{c1}', ''), string_split('{c2}', '')))) AS DOUBLE) + least(length('{c1}'), length('{c2}')) / CAST(greatest(length('{c1}'), length('{c2}')) AS DOUBLE)) / 2 END AS name_similarity,
(SELECT count(*) FROM (SELECT DISTINCT CAST({c1} AS VARCHAR) AS v FROM {t1} INTERSECT SELECT DISTINCT CAST({c2} AS VARCHAR) FROM {t2}) i) / CAST(least((SELECT count(DISTINCT {c1}) FROM {t1}), (SELECT count(DISTINCT {c2}) FROM {t2})) AS DOUBLE) AS overlap,
(SELECT count(DISTINCT {c1}) / CAST(count({c1}) AS DOUBLE) FROM {t1}) AS u1, (SELECT count(DISTINCT {c2}) / CAST(count({c2}) AS DOUBLE) FROM {t2}) AS u2,
(SELECT typeof(any_value({c1})) FROM {t1}) = (SELECT typeof(any_value({c2})) FROM {t2}) AS same_type"""


_REL = "WITH p AS (" + " UNION ALL ".join(_pair_sql(*p) for p in _PAIRS) + """), b AS (SELECT *, 0.4 * name_similarity + 0.4 * overlap + CASE WHEN regexp_matches(column_1, '(id|key|code|no)$') AND regexp_matches(column_2, '(id|key|code|no)$') THEN 0.15 ELSE 0 END + CASE WHEN same_type THEN 0.05 ELSE 0 END AS base FROM p),
c AS (SELECT *, round(CASE WHEN u1 < 0.1 AND u2 < 0.1 THEN base * 0.7 ELSE base END, 6) AS confidence FROM b),
r AS (SELECT table_1, column_1, table_2, column_2, round(name_similarity, 6) AS name_similarity, round(overlap, 6) AS overlap, confidence,
CASE WHEN u1 > 0.95 AND u2 > 0.95 THEN 'primary_key' WHEN u1 > 0.95 OR u2 > 0.95 THEN 'foreign_key' WHEN name_similarity > 0.8 THEN 'common_column' ELSE 'lookup' END AS relationship,
CASE WHEN overlap > 0.8 THEN 'inner' WHEN overlap > 0.5 THEN 'left' ELSE 'full' END AS join_type FROM c WHERE confidence >= 0.5) """


@register("relationship_pairs", "", _REL + "SELECT * FROM r")
def relationship_pairs(read_):
    return align.relationships(_tables(read_), _PAIRS)


@register("related_tables", "", _REL + ", e AS (SELECT table_1 AS a, table_2 AS b, confidence FROM r UNION ALL SELECT table_2, table_1, confidence FROM r) SELECT b AS related, count(*) AS n, round(least(1.0, avg(confidence) * (1 + 0.1 * count(*))), 6) AS relevance FROM e WHERE a = 'nation' GROUP BY b")
def related_tables(read_):
    return align.related_tables(align.relationships(_tables(read_), _PAIRS), "nation")


_STAR = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
}

_ALL_REL = "WITH cells AS (" + " UNION ALL ".join(f"SELECT {i} AS tab, '{t}' AS t, '{c}' AS c, typeof({c}) AS kind, CAST({c} AS VARCHAR) AS raw FROM {t}" for i, (t, cs) in enumerate(_STAR.items()) for c in cs) + """),
cols AS (SELECT tab, t, c, any_value(kind) AS kind, count(DISTINCT lower(trim(raw))) AS d, count(DISTINCT raw) / CAST(nullif(count(raw), 0) AS DOUBLE) AS u FROM cells GROUP BY tab, t, c),
vals AS (SELECT DISTINCT tab, t, c, lower(trim(raw)) AS v FROM cells WHERE raw IS NOT NULL),
met AS (SELECT a.t AS t1, a.c AS c1, b.t AS t2, b.c AS c2, count(*) AS common FROM vals a JOIN vals b ON a.v = b.v AND a.tab < b.tab GROUP BY ALL),
p AS (SELECT a.t AS table_1, a.c AS column_1, b.t AS table_2, b.c AS column_2, a.u AS u1, b.u AS u2, a.kind = b.kind AS same_type, coalesce(met.common / CAST(least(a.d, b.d) AS DOUBLE), 0) AS overlap,
list_distinct(string_split(a.c, '')) AS l1, list_distinct(string_split(b.c, '')) AS l2, length(a.c) AS n1, length(b.c) AS n2
FROM cols a JOIN cols b ON a.tab < b.tab LEFT JOIN met ON met.t1 = a.t AND met.c1 = a.c AND met.t2 = b.t AND met.c2 = b.c),
s AS (SELECT *, CASE WHEN column_1 = column_2 THEN 1.0 WHEN rtrim(column_1, '_id') = rtrim(column_2, '_id') THEN 0.95 ELSE (len(list_intersect(l1, l2)) / CAST(len(list_distinct(list_concat(l1, l2))) AS DOUBLE) + least(n1, n2) / CAST(greatest(n1, n2) AS DOUBLE)) / 2 END AS name_similarity FROM p),
b AS (SELECT *, 0.4 * name_similarity + 0.4 * overlap + CASE WHEN regexp_matches(column_1, '(id|key|code|no)$') AND regexp_matches(column_2, '(id|key|code|no)$') THEN 0.15 ELSE 0 END + CASE WHEN same_type THEN 0.05 ELSE 0 END AS base FROM s),
k AS (SELECT *, round(CASE WHEN u1 < 0.1 AND u2 < 0.1 THEN base * 0.7 ELSE base END, 6) AS confidence FROM b),
r AS (SELECT table_1, column_1, table_2, column_2, round(name_similarity, 6) AS name_similarity, round(overlap, 6) AS overlap, confidence,
CASE WHEN u1 > 0.95 AND u2 > 0.95 THEN 'primary_key' WHEN u1 > 0.95 OR u2 > 0.95 THEN 'foreign_key' WHEN name_similarity > 0.8 THEN 'common_column' ELSE 'lookup' END AS relationship,
CASE WHEN overlap > 0.8 THEN 'inner' WHEN overlap > 0.5 THEN 'left' ELSE 'full' END AS join_type FROM k WHERE confidence >= 0.5) """


@register("relationship_pairs_all", "", _ALL_REL + "SELECT * FROM r")
def relationship_pairs_all(read_):
    """Every pair of columns of different tables of the star schema."""
    return align.relationships({t: read_(t) for t in _STAR})


@register("related_tables_all", "", _ALL_REL + ", e AS (SELECT table_1 AS a, table_2 AS b, confidence FROM r UNION ALL SELECT table_2, table_1, confidence FROM r) SELECT b AS related, count(*) AS n, round(least(1.0, avg(confidence) * (1 + 0.1 * count(*))), 6) AS relevance FROM e WHERE a = 'nation' GROUP BY b")
def related_tables_all(read_):
    return align.related_tables(align.relationships({t: read_(t) for t in _STAR}), "nation")


@register("column_profiles", "", " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS distinct_values, round(count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE), 6) AS uniqueness FROM {t}" for t, cs in {"nation": ("n_nationkey", "n_name", "n_regionkey"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")}.items() for c in cs))
def column_profiles(read_):
    return align.column_profiles({t: read_(t) for t in ("nation", "supplier")}).withColumn("uniqueness", F.round("uniqueness", 6)).drop("dtype")


_HEADERS = {"supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}
_FILLED = {t: " UNION ALL ".join(f"SELECT '{c}' AS header FROM {t} HAVING count({c}) > 0" for c in cols) for t, cols in _HEADERS.items()}
_FUZZY = (
    f"WITH l AS (SELECT header AS left_column FROM ({_FILLED['supplier']})), r AS (SELECT header AS right_column FROM ({_FILLED['customer']})) "
    "SELECT left_column, right_column FROM l, r WHERE left_column = right_column "
    "OR 1 - levenshtein(left_column, right_column) / CAST(greatest(length(left_column), length(right_column)) AS DOUBLE) >= 0.8"
)


@register("fuzzy_columns", "", _FUZZY)
def fuzzy_columns(read_):
    """Headers are those of the tables' own columns that hold a value in any row."""
    return align.match_columns(align.filled_columns(read_("supplier")), align.filled_columns(read_("customer")), 0.8)


@register("masked_columns", "customer", "SELECT c_custkey, '***MASKED***' AS card_number, '***MASKED***' AS cvv, '***MASKED***' AS compensation, c_mktsegment FROM customer")
def masked_columns(df):
    return access.mask(df.select("c_custkey", F.col("c_name").alias("card_number"), F.col("c_nationkey").alias("cvv"), F.col("c_acctbal").alias("compensation"), "c_mktsegment"), "viewer")


_GRANTS = "WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 10 = 0 THEN '*' ELSE CAST(c_custkey AS VARCHAR) END AS file_id, CASE WHEN c_custkey % 10 = 0 THEN 'analyst' WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'viewer' END AS role FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey IN (SELECT min(c_custkey) FROM customer WHERE c_custkey % 10 = 0 GROUP BY c_nationkey)), q AS (SELECT CAST(c_nationkey AS VARCHAR) AS user_id, CAST(c_custkey AS VARCHAR) AS file_id, 'analyst' AS needed FROM customer) "


def _grants(df):
    ten = F.col("c_custkey") % 10 == 0
    keep = df.where(ten).groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey")).select("c_custkey")
    base = df.where(~ten).unionByName(df.join(keep, "c_custkey", "left_semi").select(*df.columns))
    role = F.when(ten, "analyst").when(F.col("c_custkey") % 3 == 0, "admin").otherwise("viewer")
    return base.select(F.col("c_nationkey").cast("string").alias("user_id"), F.when(ten, "*").otherwise(F.col("c_custkey").cast("string")).alias("file_id"), role.alias("role"))


@register("role_filter", "customer", _GRANTS + "SELECT q.user_id, q.file_id, q.needed, coalesce(o.role, a.role) AS role, coalesce(CASE coalesce(o.role, a.role) WHEN 'viewer' THEN 1 WHEN 'analyst' THEN 2 WHEN 'developer' THEN 3 WHEN 'admin' THEN 4 END, 0) >= 2 AS allowed FROM q LEFT JOIN g o ON o.user_id = q.user_id AND o.file_id = q.file_id LEFT JOIN g a ON a.user_id = q.user_id AND a.file_id = '*'")
def role_filter(df):
    requests = df.select(F.col("c_nationkey").cast("string").alias("user_id"), F.col("c_custkey").cast("string").alias("file_id"), F.lit("analyst").alias("needed"))
    return access.effective_roles(requests, _grants(df)).select("user_id", "file_id", "needed", "role", "allowed")


@register("visible_rows", "customer", _GRANTS + "SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT file_id FROM g WHERE user_id = '3' AND file_id <> '*')")
def visible_rows(df):
    rows = df.select("c_custkey", F.col("c_custkey").cast("string").alias("key"))
    return access.visible_rows(rows, _grants(df), "3", "key").select("c_custkey")


@register("file_scores", "part", "WITH s AS (SELECT p_partkey AS file_id, 0.5 * (p_size / 50.0) + 0.3 * (len(list_intersect(regexp_split_to_array(lower(p_type), '[_\\-\\s.]+'), ['brushed', 'steel'])) / 2.0) + 0.2 * ((p_partkey % 10) / 10.0) + least(0.2, 0.1 * CAST(contains(lower(p_type), 'promo') AS INT)) AS x FROM part) SELECT file_id, round(least(greatest(x, 0), 1), 6) AS score, round(least(greatest(x, 0), 1), 6) < 0.2 AS rejected FROM s")
def file_scores(df):
    files = df.select(F.col("p_partkey").alias("file_id"), F.col("p_type").alias("file_name"), (F.col("p_size") / 50.0).alias("semantic"), ((F.col("p_partkey") % 10) / 10.0).alias("preference"))
    return ranking.file_scores(files, "steel brushed", ["promo"]).select("file_id", "score", "rejected")


@register("file_decision", "part", "WITH s AS (SELECT p_partkey AS file_id, round(p_size / 50.0 * 0.5 + 0.2 * ((p_partkey % 10) / 10.0), 6) AS score FROM part), t AS (SELECT * FROM s WHERE score >= 0.2 ORDER BY score DESC, file_id LIMIT 3) SELECT max(score) AS best, CASE WHEN max(score) > 0.9 THEN 'auto' WHEN max(score) >= 0.5 THEN 'clarify' ELSE 'low_confidence' END AS action FROM t")
def file_decision(df):
    files = df.select(F.col("p_partkey").alias("file_id"), F.lit("").alias("file_name"), (F.col("p_size") / 50.0).alias("semantic"), ((F.col("p_partkey") % 10) / 10.0).alias("preference"))
    return ranking.file_decision(ranking.file_scores(files, "zzz")).select("best", "action")


_SHEETS = (
    "WITH q AS (SELECT c_mktsegment AS sheet_name, count(*) FILTER (WHERE c_acctbal > 0) / CAST(count(*) AS DOUBLE) AS content FROM customer GROUP BY 1), "
    "s AS (SELECT sheet_name, round(0.3 * CASE WHEN sheet_name = 'BUILDING' THEN 1.0 ELSE 0.0 END + 0.4 * 0.5 + 0.2 * 1.0 + 0.1 * content, 6) AS score FROM q) "
)


def _sheets(df):
    """A sheet for each market segment: its content is the share of accounts in credit."""
    content = F.count_if(F.col("c_acctbal") > 0) / F.count("*")
    sheets = df.groupBy(F.col("c_mktsegment").alias("sheet_name")).agg(content.alias("content"))
    return sheets.withColumns({"headers": F.array(F.lit("Customer"), F.lit("Balance")), "data_types": F.array(F.lit("number"), F.lit("text"))})


@register("sheet_scores", "customer", _SHEETS + "SELECT sheet_name, score FROM s")
def sheet_scores(df):
    return ranking.sheet_scores(_sheets(df), "total balance in building", ["number"]).select("sheet_name", "score")


@register("sheet_decision", "customer", _SHEETS + "SELECT count(*) FILTER (WHERE score > 0.7) AS strong, max(score) AS best, CASE WHEN count(*) FILTER (WHERE score > 0.7) > 1 THEN 'multi_sheet' WHEN count(*) FILTER (WHERE score > 0.7) = 1 THEN 'auto' WHEN max(score) < 0.5 THEN 'clarify' ELSE 'moderate' END AS action FROM s")
def sheet_decision(df):
    return ranking.sheet_decision(ranking.sheet_scores(_sheets(df), "total balance in building", ["number"]))


@register("confidence", "orders", "SELECT o_orderkey, round(0.4 * ((o_orderkey % 11) / 10.0) + 0.3 * 0.8 + 0.3 * least(greatest(1 - 0.3 * ((o_orderkey % 5) / 5.0) - least(0.05 * (o_orderkey % 7), 0.2), 0), 1), 6) AS confidence FROM orders")
def confidence(df):
    k = F.col("o_orderkey")
    return df.select("o_orderkey", F.round(ranking.answer_confidence((k % 11) / 10.0, F.lit(0.8), (k % 5) / 5.0, k % 7), 6).alias("confidence"))


@register("cost_estimate", "orders", "SELECT o_orderkey, round((1 + 10 * (o_orderkey % 4) + 0.001 * o_custkey) * 1.5 * CASE WHEN o_orderstatus = 'F' THEN 0.8 ELSE 1 END, 6) AS cost FROM orders")
def cost_estimate(df):
    return df.select("o_orderkey", F.round(ranking.query_cost(F.col("o_orderkey") % 4, F.col("o_custkey"), F.lit(1.5), F.col("o_orderstatus") == "F"), 6).alias("cost"))


@register("quality_score", "documents", "SELECT doc_id, round(least(greatest(0.25 * (1 + CAST(n_chars > 100 AS INT) + (doc_id % 10) / 10.0 + (doc_id % 7) / 7.0) - least(0.1 * (doc_id % 8), 0.5), 0), 1), 6) AS score FROM documents")
def quality_score(df):
    i = F.col("doc_id")
    return df.select("doc_id", F.round(ranking.quality_score((i % 10) / 10.0, (i % 7) / 7.0, F.lit(True), F.col("n_chars") > 100, i % 8), 6).alias("score"))


def _asked(pattern: str) -> str:
    return f"regexp_matches(q, '{pattern}')"


_HITS = {kind: " + ".join(f"{_asked(chr(92) + 'b' + word + chr(92) + 'b')}::INT" for word in words) for kind, words in question.KEYWORDS.items()}
_BOOSTS = {
    "aggregation": _asked(r"\b(sum|total|average|count|how many|median|maximum|minimum)\b"),
    "lookup": _asked(r"^(find|show|get|look up)\b"),
    "summarization": _asked(r"^(summari[sz]e|describe|give .*(summary|overview))"),
    "comparison": _asked(r"^compare\b|\b(vs|versus)\b"),
}
_FIRST = " ".join(f"WHEN {_asked(pattern)} THEN '{name}'" for name, pattern in question.FUNCTIONS)
_KINDS = (
    "WITH a AS (SELECT conv_id, turn, lower(text) AS q FROM conversations WHERE role = 'user'), "
    f"s AS (SELECT *, {', '.join(f'{_HITS[k]} + CASE WHEN {_BOOSTS[k]} THEN 1.5 ELSE 0 END AS {k}' for k in _HITS)}, CASE {_FIRST} ELSE 'sum' END AS function FROM a), "
    "b AS (SELECT *, greatest(aggregation, lookup, summarization, comparison) AS best, aggregation + lookup + summarization + comparison AS whole FROM s) "
    "SELECT conv_id, turn, CASE WHEN whole = 0 THEN 'lookup' WHEN aggregation = best THEN 'aggregation' WHEN lookup = best THEN 'lookup' WHEN summarization = best THEN 'summarization' ELSE 'comparison' END AS kind, "
    "round(CASE WHEN whole = 0 THEN 0.25 ELSE CAST(best AS DOUBLE) / CAST(whole AS DOUBLE) END, 6) AS confidence, function FROM b"
)


@register("question_kinds", "conversations", _KINDS)
def question_kinds(df):
    """Every user message classified as a question."""
    asked = df.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    return question.classify(asked).select("conv_id", "turn", "kind", "confidence", "function")
