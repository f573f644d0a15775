"""Exports as CSV, JSON, Parquet and workbooks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_columns(df: DataFrame) -> DataFrame:
    """Every column as CSV text: nested values as JSON, times in ISO form, booleans in lower case, nulls empty."""
    out = []
    for c, t in df.dtypes:
        col = F.col(f"`{c}`")
        if t.startswith(("array", "map", "struct")):
            text = F.to_json(col)
        elif t.startswith("timestamp"):
            text = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            text = col.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(c))
    return df.select(*out)


def export(df: DataFrame, path: str, kind: str = "csv", limit: int | None = 100_000, metadata: dict | None = None) -> None:
    """Write in parallel. An empty result or one over `limit` rows (None: no limit) is refused; the check reads at
    most limit + 1 rows."""
    n = df.limit((limit or 1) + 1).count()
    if n == 0:
        raise ValueError("nothing to export")
    if limit is not None and n > limit:
        raise ValueError(f"more than {limit} rows")
    if kind == "csv":
        csv_columns(df).write.mode("overwrite").csv(path, header=True, emptyValue="")
    elif kind == "json":
        (df if metadata is None else df.withColumn("_metadata", F.lit(json.dumps(metadata, sort_keys=True)))).write.mode("overwrite").json(path)
    elif kind == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif kind == "xlsx":
        from .workbook import register

        register(df.sparkSession)
        df.write.format("workbook").mode("overwrite").save(path)
    else:
        raise ValueError(f"unknown format: {kind}")


def column_role(name: str) -> str:
    """currency, percentage or plain, by name."""
    low = name.lower()
    if any(w in low for w in ("price", "cost", "revenue", "amount", "total", "salary")):
        return "currency"
    return "percentage" if any(w in low for w in ("percent", "pct", "rate", "ratio")) else "plain"
