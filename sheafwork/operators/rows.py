"""Row numbers of an ordered table, and slices of it that read only the partitions they lie in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import staging

#: Offsets up to here are cheaper as a top-k (each task keeps so many rows) than as a written index.
SHALLOW = 10_000


@dataclass
class RowIndex:
    """A table laid out in ranges of its order: a folder for each range (`_part`), rows numbered within it (`_pos`)."""

    spark: SparkSession
    path: str
    schema: object
    starts: list[tuple[int, int, int]]  # part, first row number, rows; as many as there are partitions

    @classmethod
    def build(cls, df: DataFrame, order: list[str | Column], parts: int | None = None, label: str = "rows") -> RowIndex:
        """Order ties are broken by the input's order, so give a key where the order must not depend on files."""
        spark = df.sparkSession
        keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
        marked = df.withColumn("_tie", F.monotonically_increasing_id())
        laid = marked.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
        at = F.monotonically_increasing_id()
        laid = laid.withColumn("_part", F.spark_partition_id()).withColumn("_pos", at.bitwiseAND((1 << 33) - 1))
        path = staging.new_path(spark, label)
        laid.write.partitionBy("_part").parquet(path)
        index = cls(spark, path, laid.schema, [])
        first = 0
        for part, n in sorted(tuple(r) for r in index._table().groupBy("_part").count().collect()):
            index.starts.append((part, first, n))
            first += n
        return index

    def _table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def count(self) -> int:
        return sum(n for *_, n in self.starts)

    def frame(self) -> DataFrame:
        """All rows with `row_idx`, gapless from 0; one literal for each partition gives its first number."""
        if not self.starts:
            return self._table().drop("_part", "_pos").withColumn("row_idx", F.lit(0).cast("long"))
        firsts = F.create_map(*[F.lit(v) for part, first, _ in self.starts for v in (part, first)])
        return self._table().withColumn("row_idx", firsts[F.col("_part")] + F.col("_pos")).drop("_part", "_pos")

    def slice(self, offset: int, size: int) -> DataFrame:
        """Rows offset to offset + size - 1 with `row_idx`: partitions outside aren't listed, row groups outside aren't read."""
        met = [(p, first, n) for p, first, n in self.starts if first < offset + size and first + n > offset]
        kept = F.lit(False)
        for part, first, _ in met:
            kept = kept | ((F.col("_part") == part) & F.col("_pos").between(max(offset - first, 0), offset + size - 1 - first))
        # the list of partitions prunes folders; the positions are tested again above
        rows = self._table().where(F.col("_part").isin([p for p, *_ in met]) & kept)
        firsts = F.create_map(*[F.lit(v) for part, first, _ in met or [(0, 0, 0)] for v in (part, first)])
        return rows.withColumn("row_idx", firsts[F.col("_part")] + F.col("_pos")).drop("_part", "_pos").orderBy("row_idx")


def row_numbers(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with `row_idx`, gapless from 0 in the given order, without a window over the whole table."""
    return RowIndex.build(df, order).frame()


def rows_at(df: DataFrame, order: list[str | Column], offset: int, size: int) -> DataFrame:
    """Rows offset to offset + size - 1 of the order. Deep offsets go through a row index instead of one task's sort."""
    keys = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order]
    if offset + size <= SHALLOW:
        return df.orderBy(*keys).offset(offset).limit(size)
    return RowIndex.build(df, order).slice(offset, size).drop("row_idx")


def page_after(df: DataFrame, key: list[str], last: list | None, size: int) -> DataFrame:
    """The next page by key: rows whose key (ascending, without nulls) is over the last one seen. The comparison reaches the scan, so
    no page costs more than the one before it."""
    if last is not None:
        after = F.lit(False)
        for i, (name, value) in enumerate(zip(key, last)):
            same = F.lit(True)
            for n, v in zip(key[:i], last[:i]):
                same = same & (F.col(f"`{n}`") == v)
            after = after | (same & (F.col(f"`{name}`") > value))
        df = df.where((F.col(f"`{key[0]}`") >= last[0]) & after)
    return df.orderBy(*[F.col(f"`{k}`") for k in key]).limit(size)


def side_by_side(tables: dict[str, DataFrame], order: dict[str, list[str | Column]], columns: list[str], limit: int | None = None) -> DataFrame:
    """Row i of every table in one row: row_index and a column `<table>_<column>` each; missing rows and columns are null.

    Each table is numbered by its own order; tables meet by row number. With a limit only the first rows of each are numbered.
    """
    out = None
    for name, df in tables.items():
        numbered = (RowIndex.build(df, order[name]).slice(0, limit) if limit else row_numbers(df, order[name])).withColumnRenamed("row_idx", "row_index")
        own = numbered.select("row_index", *[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).alias(f"{name}_{c}") for c in columns])
        out = own if out is None else out.join(own, "row_index", "full_outer")
    return out


def comparison_counts(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """total_files, total_columns (given), total_rows and files_with_missing_columns of a comparison; rows are counted in one job."""
    parts = [df.select(F.lit(1).alias("one")) for df in tables.values()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    missing = sum(any(c not in df.columns for c in columns) for df in tables.values())
    return whole.agg(F.lit(len(tables)).alias("total_files"), F.lit(len(columns)).alias("total_columns"), F.count("*").alias("total_rows"), F.lit(missing).alias("files_with_missing_columns"))
