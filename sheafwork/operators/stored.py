"""A stored table with keys: merges rewrite only the buckets they touch, and a snapshot switches at once.

    <path>/data/<snapshot>/_bucket=<b>/*.parquet     rows of a bucket (a hash of the key) as a snapshot wrote them
    <path>/snapshots/<n>.json                        which folder holds each bucket, the schema, and the last batch of each writer

A merge writes new folders for the touched buckets, then one small file names them; until that file is there, readers see the
snapshot before. A job that fails or is repeated leaves folders that no snapshot names (`vacuum` removes them). There is one writer at a time;
a second one that commits the same number is refused. Batches of a stream are told by number: one that came before changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.package import file_system


class ConcurrentMerge(RuntimeError):
    """Another writer committed first."""


@dataclass
class Snapshot:
    number: int
    key: list[str]
    n_buckets: int
    schema: str
    buckets: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store, self.inner = file_system(self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: list[str], n_buckets: int = 64) -> StoredTable:
        """An empty table. Choose buckets so that one fits a task: a bucket is the least that a merge rewrites."""
        table = cls(spark, path)
        if table._numbers():
            raise FileExistsError(path)
        table._commit(Snapshot(0, key, n_buckets, schema.json()))
        return table

    def _numbers(self) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(f"{self.inner}/snapshots", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        numbers = self._numbers()
        if not numbers or (number is not None and number not in numbers):
            raise FileNotFoundError(f"no such snapshot of {self.path}: {number}")
        with self.store.open_input_stream(f"{self.inner}/snapshots/{numbers[-1] if number is None else number:010d}.json") as f:
            return Snapshot(**json.loads(f.read()))

    def _commit(self, snapshot: Snapshot) -> None:
        folder = f"{self.inner}/snapshots"
        self.store.create_dir(folder)
        target, new = f"{folder}/{snapshot.number:010d}.json", f"{folder}/.{uuid.uuid4().hex}"
        with self.store.open_output_stream(new) as f:
            f.write(json.dumps(asdict(snapshot)).encode())
        if self.store.get_file_info(target).type != fs.FileType.NotFound:
            self.store.delete_file(new)
            raise ConcurrentMerge(f"snapshot {snapshot.number} of {self.path} exists")
        self.store.move(new, target)

    @staticmethod
    def _bucket(snapshot: Snapshot) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in snapshot.key]), F.lit(snapshot.n_buckets)).cast("int")

    def _rows(self, snapshot: Snapshot, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(snapshot.schema))
        folders = [f for b, f in snapshot.buckets.items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a snapshot (the latest by default)."""
        return self._rows(self.snapshot(number))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is in `keys`; only their buckets are read. The buckets of the keys are asked for first (an action)."""
        snapshot = self.snapshot()
        met = [r[0] for r in keys.select(self._bucket(snapshot)).distinct().collect()]  # at most n_buckets
        return self._rows(snapshot, met).join(keys.select(*snapshot.key).distinct(), snapshot.key, "left_semi")

    def merge(self, updates: DataFrame, order: str | None = None, deleted: Column | None = None, writer: str = "", batch: int | None = None) -> Snapshot:
        """Updates replace the rows of their keys or are added; rows for which `deleted` holds remove their key.

        Of several updates of a key the one with the largest `order` counts (without one, any). Rows whose key is null are refused. Returns the snapshot
        that holds the result: the present one if this writer's batch was merged before, or if nothing comes in.
        """
        from . import staging

        old = self.snapshot()
        if batch is not None and batch <= old.batches.get(writer, -1):
            return old
        columns = StructType.fromJson(json.loads(old.schema)).names
        rows = updates.select(*[F.col(f"`{c}`") for c in columns], (F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)).alias("_deleted"), *([F.col(f"`{order}`").alias("_order")] if order else []))
        newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns], "_deleted"), "_order" if order else F.lit(0))
        rows = rows.groupBy(*[F.col(f"`{k}`") for k in old.key]).agg(newest.alias("_row")).select("_row.*").withColumn("_bucket", self._bucket(old))
        rows = staging.stage_table(rows, "updates")  # they are read three times, and a batch must not change in between
        nulls = F.lit(False)
        for k in old.key:
            nulls = nulls | F.col(f"`{k}`").isNull()
        if not rows.where(nulls).isEmpty():
            raise ValueError("updates without a key")
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        new = Snapshot(old.number + 1, old.key, old.n_buckets, old.schema, dict(old.buckets), dict(old.batches))
        if batch is not None:
            new.batches[writer] = batch
        if touched:
            kept = self._rows(old, touched).join(rows.select(*old.key), old.key, "left_anti").withColumn("_bucket", self._bucket(old))
            whole = kept.unionByName(rows.where("not _deleted").drop("_deleted"))
            folder = f"{new.number:010d}-{uuid.uuid4().hex}"
            # a task for each touched bucket: keys hash evenly, so no bucket is hot
            whole.repartition(len(touched), "_bucket").sortWithinPartitions("_bucket", *old.key).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
            there = {f.base_name for f in self.store.get_file_info(fs.FileSelector(f"{self.inner}/data/{folder}"))}
            for b in touched:
                name = f"_bucket={b}"
                if name in there:
                    new.buckets[str(b)] = f"{folder}/{name}"
                else:
                    new.buckets.pop(str(b), None)  # all its rows were deleted
        elif batch is None:
            return old
        self._commit(new)
        return new

    def stream_writer(self, writer: str, order: str | None = None, deleted: Column | None = None) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: a batch that is repeated after a failure changes nothing."""

        def write(batch: DataFrame, number: int) -> None:
            self.merge(batch, order, deleted, writer, number)

        return write

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the last `keep` snapshots and every bucket's folder that none of those names; returns how many."""
        numbers = self._numbers()
        kept = {f for n in numbers[-keep:] for f in self.snapshot(n).buckets.values()}
        for n in numbers[:-keep]:
            self.store.delete_file(f"{self.inner}/snapshots/{n:010d}.json")
        removed = 0
        for snapshot in self.store.get_file_info(fs.FileSelector(f"{self.inner}/data", allow_not_found=True)):
            within = [f for f in self.store.get_file_info(fs.FileSelector(snapshot.path)) if f.base_name.startswith("_bucket=")]
            gone = [f for f in within if f"{snapshot.base_name}/{f.base_name}" not in kept]
            for f in gone if len(gone) < len(within) else [snapshot]:
                self.store.delete_dir(f.path)
            removed += len(gone)
        return removed
