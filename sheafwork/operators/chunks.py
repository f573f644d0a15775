"""Overlapping row windows as text chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import row_text


def window_numbers(index: Column, rows: Column, size: int = 50, overlap: int = 5) -> Column:
    """The windows a row lies in: they start every size - overlap rows and stop at the first to reach the end."""
    step = max(1, size - overlap)
    last = F.when(rows <= size, 0).otherwise(F.ceil((rows - size) / step))
    first = F.greatest(F.lit(0), F.ceil((index - size + 1) / step))
    return F.sequence(first.cast("int"), F.least(last, F.floor(index / step)).cast("int"))


def chunk_rows(df: DataFrame, table_column: str, index: str, text: Column, size: int = 50, overlap: int = 5) -> DataFrame:
    """table_column, chunk, start_row, end_row, n_rows and content (lines in row order). A chunk holds at most
    `size` rows, so gathering its lines is bounded however large the table."""
    counts = df.groupBy(table_column).agg((F.max(index) + 1).alias("_rows"))
    each = df.join(counts, table_column).select(table_column, index, text.alias("_line"), F.explode(window_numbers(F.col(index), F.col("_rows"), size, overlap)).alias("chunk"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(index, "_line"))), lambda r: r["_line"])
    return each.groupBy(table_column, "chunk").agg(F.min(index).alias("start_row"), F.max(index).alias("end_row"), F.count("*").alias("n_rows"), F.array_join(lines, "\n").alias("content"))


def chunk_header(file: Column, sheet: Column, start: Column, end: Column, columns: list[str]) -> Column:
    return F.concat(F.lit("File: "), file, F.lit("\nSheet: "), sheet, F.lit("\nRows: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\nColumns: " + ", ".join(columns)))


def column_summaries(df: DataFrame, numeric: list[str], label: str) -> DataFrame:
    """column and a sentence with least, largest and mean of up to 10 numeric columns, from one scan."""
    chosen = numeric[:10]
    row = df.agg(*[f(c).alias(f"{c}_{k}") for c in chosen for k, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg))])
    item = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"{c}_lo").cast("double").alias("least"), F.col(f"{c}_hi").cast("double").alias("largest"), F.round(f"{c}_avg", 4).alias("mean"))
    out = row.select(F.explode(F.array(*[item(c) for c in chosen])).alias("r")).select("r.*")
    return out.withColumn("content", F.format_string(f"Column %s of {label}: min %.2f, max %.2f, average %.2f", "column", "least", "largest", "mean"))


#: What a question may ask for, and the flag of a chunk's metadata that it needs.
FLAGS = {"numbers": "has_numbers", "dates": "has_dates", "pivots": "has_pivot_tables", "charts": "has_charts"}


def chunk_condition(file_id: str | None = None, strategy: str | None = None, sheet_name: str | None = None, content_type: str | None = None, least_quality: float | None = None) -> Column:
    """Filters of stored chunks (file_id, extraction_strategy, chunk_text, quality_score); what is None doesn't count.

    Sheet and content type are looked for in the text without regard to case; `%` and `_` in them are wildcards. The equalities and the
    score reach the scan.
    """
    parts = [F.lit(True)]
    parts += [F.col("file_id") == file_id] if file_id is not None else []
    parts += [F.col("extraction_strategy") == strategy] if strategy is not None else []
    parts += [F.col("chunk_text").ilike(f"%{x}%") for x in (sheet_name, content_type) if x is not None]
    parts += [F.col("quality_score") >= least_quality] if least_quality is not None else []
    return reduce(lambda a, b: a & b, parts)


def analysis_condition(requested: list[str], more: dict[str, object] | None = None) -> Column:
    """Chunks that hold what a question asks for (numbers, dates, pivots, charts) and match further metadata values."""
    wanted = {FLAGS[r]: True for r in requested if r in FLAGS} | (more or {})
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items()], F.lit(True))


def compare_strategies(df: DataFrame, file: str, strategy: str, score: str) -> DataFrame:
    """Each file's strategies: how many, the one with the best mean score (ties: first by name), its score and the lead over the mean of all."""
    each = df.groupBy(file, strategy).agg(F.avg(score).alias("_score"))
    top = each.groupBy(file).agg(F.max("_score").alias("best_score"), F.count("*").alias("strategies"), F.avg("_score").alias("_mean"))
    first = each.join(top, file).where(F.col("_score") == F.col("best_score")).groupBy(file).agg(F.min(strategy).alias("best_strategy"))
    return top.join(first, file).select(file, "strategies", "best_strategy", "best_score", (F.col("best_score") - F.col("_mean")).alias("lead"))


__all__ = ["analysis_condition", "chunk_condition", "chunk_header", "chunk_rows", "column_summaries", "compare_strategies", "row_text", "window_numbers"]
