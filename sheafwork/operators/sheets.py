"""Merged ranges filled over their rows, and pivot tables run from their definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import plain_number
from ..functions.text import language_of_counts, script_counts

#: Rows of a sheet that share a bucket: a range meets a row through a bucket, so it is copied once for each of these, not once a row.
BUCKET = 4096
_SHEET = ["file_name", "sheet_name"]


def fill_merged(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """rows with every cell of a merged range showing the range's top left value; the first of overlapping ranges counts.

    rows: file_name, sheet_name, row_idx (from 1), cells; other columns stay. merged: as the workbook source's content
    `merged`. Rows that a range covers but the file lacks come as new rows. Ranges meet rows by equal sheet and bucket of rows, then by
    containment; a row gathers only the ranges across it, which a sheet's width bounds.
    """
    bucket = F.floor(F.col("row_idx") / BUCKET)
    corner = merged.join(rows.select(*_SHEET, F.col("row_idx").alias("first_row"), "cells"), [*_SHEET, "first_row"], "left")
    corner = corner.select(*_SHEET, "first_row", "last_row", F.struct("position", "first_column", "last_column", F.try_element_at("cells", F.col("first_column")).alias("value")).alias("range"))
    covered = corner.select(*_SHEET, F.explode(F.sequence("first_row", "last_row")).alias("row_idx")).distinct()
    whole = rows.unionByName(covered.join(rows.select(*_SHEET, "row_idx"), [*_SHEET, "row_idx"], "left_anti"), allowMissingColumns=True)
    spread = corner.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first_row") / BUCKET), F.floor(F.col("last_row") / BUCKET))))
    met = whole.select(*_SHEET, "row_idx", bucket.alias("_bucket")).join(spread, [*_SHEET, "_bucket"]).where(F.col("row_idx").between(F.col("first_row"), F.col("last_row")))
    across = met.groupBy(*_SHEET, "row_idx").agg(F.array_sort(F.collect_list("range")).alias("_ranges"))
    cells = F.coalesce("cells", F.array().cast("array<string>"))
    width = F.greatest(F.size(cells), F.array_max(F.transform("_ranges", lambda r: r["last_column"])))

    def shown(i: Column) -> Column:
        own = F.filter("_ranges", lambda r: i.between(r["first_column"], r["last_column"]))
        return F.when(F.size(own) > 0, F.try_element_at(own, F.lit(1))["value"]).otherwise(F.try_element_at(cells, i))

    filled = F.when(F.col("_ranges").isNull(), cells).otherwise(F.transform(F.sequence(F.lit(1), width), shown))
    return whole.join(across, [*_SHEET, "row_idx"], "left").withColumn("cells", filled).drop("_ranges").select(*rows.columns)


#: What a pivot's summary functions are called in files.
FUNCTIONS = {
    "sum": F.sum, "count": F.count, "average": F.avg, "max": F.max, "min": F.min, "product": F.product, "countNums": F.count, "stdDev": F.stddev_samp,
    "stdDevp": F.stddev_pop, "var": F.var_samp, "varp": F.var_pop,
}


def pivot(df: DataFrame, rows: list[str], columns: list[str], values: list[tuple[str, str, str]], filters: dict[str, list] | None = None) -> DataFrame:
    """A pivot table in long form: one row for each cell, with the totals that a pivot table shows.

    values: (name, field, function). filters keep the rows whose field is in a list. The row and column fields are null in
    totals; `row_total` and `column_total` tell these from null values. Rows, columns and their totals come from one pass (grouping sets).
    Functions other than count read numbers in texts.
    """
    for name, kept in (filters or {}).items():
        df = df.where(F.col(f"`{name}`").isin(kept))
    keys = [*rows, *columns]
    sets = [keys, rows, columns, []]
    types = dict(df.dtypes)
    number = lambda field, function: F.col(f"`{field}`") if function == "count" else plain_number(F.col(f"`{field}`"), types[field])
    measures = [FUNCTIONS[function](number(field, function)).alias(name) for name, field, function in values]
    unique = [s for i, s in enumerate(sets) if s not in sets[:i]]
    flags = [F.grouping(F.col(f"`{k}`")).alias(f"_g_{k}") for k in keys]
    out = df.groupingSets([[F.col(f"`{k}`") for k in s] for s in unique], *[F.col(f"`{k}`") for k in keys]).agg(*measures, *flags)
    total = lambda names: F.greatest(*[F.col(f"`_g_{k}`") for k in names], F.lit(0)) == 1
    return out.withColumn("row_total", total(rows)).withColumn("column_total", total(columns)).drop(*[f"_g_{k}" for k in keys])


def pivot_wide(long: DataFrame, rows: list[str], columns: list[str], value: str) -> DataFrame:
    """One measure of `pivot` as the sheet shows it: a column for each value of the column fields and `Total`, and a row for the totals."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("(blank)"))
    label = F.when(F.col("column_total"), "Total").otherwise(F.concat_ws(" / ", *[blank(c) for c in columns]))
    return long.withColumn("_label", label).groupBy(*[F.col(f"`{r}`") for r in rows], "row_total").pivot("_label").agg(F.first(F.col(f"`{value}`")))


def sheet_languages(rows: DataFrame, sample: int = 100) -> DataFrame:
    """language of each sheet, from its header and first `sample` rows; letters are counted by row and summed, so no sheet's text is joined."""
    return _languages(rows.where(F.col("row_idx") <= sample + 1), _SHEET)


def workbook_languages(rows: DataFrame, sample: int = 50) -> DataFrame:
    """language of each file, from the header and first `sample` rows of all its sheets."""
    return _languages(rows.where(F.col("row_idx") <= sample + 1), ["file_name"])


def _languages(rows: DataFrame, by: list[str]) -> DataFrame:
    counts = rows.where(F.col("cells").isNotNull()).select(*by, script_counts(F.array_join("cells", " ")).alias("c"))
    sums = counts.groupBy(*by).agg(*[F.sum(f"c.{k}").alias(k) for k in ("total", "thai", "latin")])
    return sums.select(*by, language_of_counts(F.col("total"), F.col("thai"), F.col("latin")).alias("language"))
