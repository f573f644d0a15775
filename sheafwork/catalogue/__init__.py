"""All registered queries of the tabular engine, by topic: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.question import answer
from . import events, quality, reports, retrieval, rows, stores, tabular, workbooks

_ALL = {**tabular.QUERIES, **quality.QUERIES, **retrieval.QUERIES, **stores.QUERIES, **reports.QUERIES, **events.QUERIES, **workbooks.QUERIES, **rows.QUERIES}

FLAGSHIP = "What is the total l_extendedprice where l_returnflag = A"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question in words over lineitem, compiled and run."""
    return answer(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), FLAGSHIP)


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
