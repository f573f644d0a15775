"""The operators that SQL can express, against that SQL on the smallest tables."""

import duckdb
import pytest

from sheafwork.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, table", [("op8_hnsw", "embeddings"), ("op10_ngram_jaccard", "documents"), ("op11_collocations", "documents")])
def test_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(found.fetchall(), key=repr)
