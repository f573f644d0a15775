"""Workbooks written from the given tables and read back by the data source; pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, sheets, staging
from ..sources import readers, workbook
from . import tabular

QUERIES: dict[str, tuple] = {}
#: Rows of a sheet that is to be read by several tasks: a task for each stretch of so many.
SHEET_ROWS = 50_000


def register(name: str, table: str, sql: str | None = None):
    return tabular.register(name, table, sql, QUERIES)


def _book(df: DataFrame, **options: str) -> str:
    workbook.register(df.sparkSession)
    path = staging.new_path(df.sparkSession, "book") + ".xlsx"
    df.write.format("workbook").options(**options).mode("overwrite").save(path)
    return path


@register("workbook_sheets", "customer", "SELECT c_mktsegment AS sheet_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def workbook_sheets(df):
    """A sheet for each segment, read back by one task each."""
    path = _book(df.select("c_mktsegment", "c_custkey", "c_name", "c_acctbal"), sheetBy="c_mktsegment")
    rows = readers.read_workbooks(df.sparkSession, path).where("row_idx > 1")
    return rows.groupBy("sheet_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("cells")[2].cast("double")), 2).alias("total"))


_ONE_SHEET = (
    "SELECT 'sum' AS aggregation, 'c_acctbal' AS target_column, round(sum(c_acctbal), 2) AS value, count(*) AS rows_processed, CAST(0 AS BIGINT) AS rows_skipped "
    "FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 10"
)


@register("workbook_table", "customer", _ONE_SHEET)
def workbook_table(df):
    """One sheet under its header row, asked as a table of texts."""
    path = _book(df.select("c_mktsegment", "c_custkey", "c_nationkey", "c_acctbal"), sheetBy="c_mktsegment")
    table = readers.read_workbooks(df.sparkSession, path, "table", sheet="BUILDING")
    return aggregate.aggregate(table, "sum", "c_acctbal", [("c_nationkey", ">=", 10)]).withColumn("value", F.round("value", 2))


@register("workbook_types", "customer", "SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'text'), ('c_acctbal', 'numeric'), ('born', 'date'), ('rich', 'boolean')) t(\"column\", kind), (SELECT count(*) AS n FROM customer)")
def workbook_types(df):
    """Types survive the file: kinds of the columns that are read back, by majority, and the number of rows."""
    born = F.date_add(F.lit("1980-01-01").cast("date"), F.col("c_custkey").cast("int") % 9000)
    columns = df.select("c_custkey", "c_name", "c_acctbal", born.alias("born"), (F.col("c_acctbal") > 0).alias("rich"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = _book(columns.repartition(parts, "c_custkey"), sheetRows=str(SHEET_ROWS))
    table = readers.read_workbooks(df.sparkSession, path, "table", continued="true").drop("file_name", "row_idx")
    table = staging.stage_table(table, "sheet-table")  # its XML is read once
    return readers.infer_types(table).crossJoin(table.agg(F.count("*").alias("n")))


@register("workbook_merged", "supplier", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def workbook_merged(df):
    """Labels written as merged cells and filled over their rows again."""
    path = _book(df.select("s_nationkey", "s_suppkey", "s_acctbal").repartitionByRange("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey"), merge="s_nationkey")
    spark = df.sparkSession
    filled = sheets.fill_merged(readers.read_workbooks(spark, path), readers.read_workbooks(spark, path, "merged")).where("row_idx > 1")
    rows = filled.select(*[F.col("cells")[i].cast(t).alias(c) for i, (c, t) in enumerate([("s_nationkey", "int"), ("s_suppkey", "long"), ("s_acctbal", "double")])])
    return rows.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


_MERGED_RANGES = (
    "SELECT CAST(s_nationkey AS VARCHAR) AS label, count(*) AS n_rows FROM supplier GROUP BY 1 HAVING count(*) > 1"
)


@register("workbook_merged_ranges", "supplier", _MERGED_RANGES)
def workbook_merged_ranges(df):
    """The merged ranges of a written sheet, with the label and the number of rows of each."""
    path = _book(df.select("s_nationkey", "s_suppkey").coalesce(1).sortWithinPartitions("s_nationkey", "s_suppkey"), merge="s_nationkey")
    spark = df.sparkSession
    ranges = readers.read_workbooks(spark, path, "merged")
    rows = readers.read_workbooks(spark, path).select("sheet_name", F.col("row_idx").alias("first_row"), F.col("cells")[0].alias("label"))
    return ranges.join(rows, ["sheet_name", "first_row"]).select("label", (F.col("last_row") - F.col("first_row") + 1).alias("n_rows"))


_LANGUAGES = (
    "WITH r AS (SELECT lang AS sheet_name, CASE WHEN lang = 'de' THEN 'รายงานยอดขายประจำปี ' || doc_id WHEN lang = 'fr' THEN 'ยอดขาย sales' ELSE regexp_extract(text, '^\\S+') END AS title, "
    "row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents UNION ALL SELECT DISTINCT lang, 'title', 0 FROM documents), "
    "c AS (SELECT sheet_name, sum(length(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g'))) AS n, "
    "sum(length(regexp_replace(title, '[^\\x{0E01}-\\x{0E30}\\x{0E32}\\x{0E33}\\x{0E40}-\\x{0E46}\\x{0E50}-\\x{0E59}]', '', 'g'))) AS t, sum(length(regexp_replace(title, '[^A-Za-z]', '', 'g'))) AS a "
    "FROM r WHERE i <= 100 GROUP BY 1) SELECT sheet_name, CASE WHEN n = 0 THEN 'en' WHEN t / n > 0.7 THEN 'th' WHEN a / n > 0.7 THEN 'en' WHEN t / n > 0.2 AND a / n > 0.2 THEN 'mixed' WHEN t > a THEN 'th' ELSE 'en' END AS language FROM c"
)


@register("sheet_languages", "documents", _LANGUAGES)
def sheet_languages(df):
    """The language of each sheet of a written workbook, from its first rows."""
    title = F.when(F.col("lang") == "de", F.concat(F.lit("รายงานยอดขายประจำปี "), F.col("doc_id").cast("string"))).when(F.col("lang") == "fr", "ยอดขาย sales").otherwise(F.regexp_extract("text", r"^\S+", 0))
    # thin rows are written once by all tasks; the ranges of their order follow each other in the file
    titles = staging.stage_table(df.select("lang", "doc_id", title.alias("title")), "titles")
    path = _book(titles.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id").drop("doc_id"), sheetBy="lang")
    found = sheets.sheet_languages(readers.read_workbooks(df.sparkSession, path)).drop("file_name")
    # over a sheet's row limit a language goes on in further sheets, whose first rows are not its first
    return found.join(titles.select(F.coalesce("lang", F.lit("None")).alias("sheet_name")).distinct(), "sheet_name", "left_semi")


_PIVOT = (
    "SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total, count(o_custkey) AS n, round(avg(o_totalprice), 4) AS mean, "
    "grouping(o_orderpriority) = 1 AS row_total, grouping(o_orderstatus) = 1 AS column_total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)"
)


@register("pivot_table", "orders", _PIVOT)
def pivot_table(df):
    values = [("total", "o_totalprice", "sum"), ("n", "o_custkey", "count"), ("mean", "o_totalprice", "average")]
    return sheets.pivot(df, ["o_orderpriority"], ["o_orderstatus"], values).withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


_PIVOT_WIDE = (
    'SELECT o_orderpriority, grouping(o_orderpriority) = 1 AS row_total, count(*) FILTER (WHERE o_orderstatus = \'F\') AS "F", count(*) FILTER (WHERE o_orderstatus = \'O\') AS "O", '
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS \"P\", count(*) AS \"Total\" FROM orders GROUP BY ROLLUP (o_orderpriority)"
)


@register("pivot_wide", "orders", _PIVOT_WIDE)
def pivot_wide(df):
    long = sheets.pivot(df, ["o_orderpriority"], ["o_orderstatus"], [("n", "o_custkey", "count")])
    return sheets.pivot_wide(long, ["o_orderpriority"], ["o_orderstatus"], "n")
