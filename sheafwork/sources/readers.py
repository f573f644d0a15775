"""Tables from Parquet, CSV and workbooks.

A workbook's sheets are read by the data source `workbook`; everything after the raw cells (header row, names, types) is
DataFrame work over (file_name, sheet_name, row_idx, cells).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import is_missing, value_type
from . import workbook

ERRORS = ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if ".parquet" in path else spark.read.csv(path, header=True, multiLine=True)


def read_workbooks(spark: SparkSession, path: str, content: str = "rows", **options: str) -> DataFrame:
    """Rows (or another content, see the data source) of every workbook below path, one task for each sheet.

    file_name, sheet_name, row_idx (from 1), cells, formulas, formats, kinds, hidden; a file that can't be read gives one row with its
    error instead of failing the job.
    """
    workbook.register(spark)
    return spark.read.format("workbook").options(content=content, **options).load(path)


def header_rows(raw: DataFrame) -> DataFrame:
    """file_name, sheet_name and header_row: of rows 1 to 5 the one with most 2 x text cells + filled cells, the first
    of equals."""
    filled = F.size(F.filter("cells", lambda c: ~is_missing(c)))
    texts = F.size(F.filter("cells", lambda c: value_type(c) == "text"))
    first = raw.where(F.col("row_idx") <= 5).withColumn("_s", 2 * texts + filled)
    return first.groupBy("file_name", "sheet_name").agg(F.max_by("row_idx", F.struct("_s", -F.col("row_idx"))).alias("header_row"))


def unique_names(cells: list[str | None]) -> list[str]:
    """Blank names become Column_<letter>, repeated ones get a number."""
    from ..operators.filters import column_letter

    out: list[str] = []
    taken: set[str] = set()
    for i, c in enumerate(cells):
        base = name = (c or "").strip() or f"Column_{column_letter(i)}"
        n = 1
        while name.lower() in taken:  # names are resolved without case
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        out.append(name)
    return out


def sheet_table(raw: DataFrame, file_name: str, sheet_name: str, limit: int | None = None) -> DataFrame:
    """One sheet as a table of text columns with row_idx; all-empty rows are dropped. Reads the header row (an action)."""
    own = raw.where((F.col("file_name") == file_name) & (F.col("sheet_name") == sheet_name))
    head = own.join(header_rows(own), ["file_name", "sheet_name"]).where("row_idx = header_row").select("row_idx", "cells").first()
    names = unique_names(head["cells"])
    body = own.where((F.col("row_idx") > head["row_idx"]) & F.exists("cells", lambda c: ~is_missing(c)))
    out = body.select((F.col("row_idx") - head["row_idx"] - 1).alias("row_idx"), *[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return out if limit is None else out.orderBy("row_idx").limit(limit)


def infer_types(df: DataFrame) -> DataFrame:
    """column and its most frequent kind of filled cell, from one scan; text where none is filled, ties by name."""
    kinds = ("boolean", "date", "numeric", "text")
    row = df.agg(*[F.struct(*[F.count_if(value_type(F.col(f"`{c}`")) == k).alias(k) for k in kinds]).alias(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}`.{k}").alias(k) for k in kinds]) for c in df.columns])
    out = row.select(F.explode(items).alias("r")).select("r.*")
    top = F.greatest(*kinds)
    return out.select("column", F.when(top == 0, "text").when(F.col("text") == top, "text").when(F.col("numeric") == top, "numeric").when(F.col("date") == top, "date").otherwise("boolean").alias("kind"))


def formula_cells(raw: DataFrame) -> DataFrame:
    """One row for each formula: its text, an error its value shows, and whether it refers to another workbook."""
    each = raw.select("file_name", "sheet_name", "row_idx", F.posexplode("formulas").alias("column_idx", "formula"), "cells").where("formula is not null")
    value = F.try_element_at("cells", F.col("column_idx") + 1)
    return each.select("file_name", "sheet_name", "row_idx", "column_idx", "formula", F.when(value.isin(*ERRORS), value).alias("error"), F.col("formula").rlike(r"\[[^\]]+\]").alias("external"))
