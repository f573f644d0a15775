"""Changes of a folder as a stream: ``spark.readStream.format("file_changes").option("path", ...).option("snapshots", ...).load()``.

Each trigger lists the folder. If the listing differs from the last one it becomes a new snapshot, a small file in the folder `snapshots`, and its
number the stream's offset; the rows of a batch are the differences of two snapshots: added, changed (size or time) and removed
files. A batch that is repeated compares the same two snapshots, so a change is neither lost nor doubled. Snapshots before the last committed one are removed.

`pattern` limits file names (shell style). The listing goes through the driver, as listings do; rows are cut into partitions of PART files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .package import file_system

PART = 10_000


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileChanges)


class FileChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return "path string, change string, size long, modified timestamp, snapshot long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangeReader(self.options["path"], self.options["snapshots"], self.options.get("pattern", "*"))


@dataclass
class Changes(InputPartition):
    rows: list[tuple]


class ChangeReader(DataSourceStreamReader):
    def __init__(self, path: str, snapshots: str, pattern: str):
        self.path, self.pattern = path, pattern
        self.store, self.inner = file_system(path)
        self.kept, self.folder = file_system(snapshots)

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def _load(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        with self.kept.open_input_stream(self._file(number)) as f:
            return json.loads(f.read())

    def _listing(self) -> dict[str, list[int]]:
        found = self.store.get_file_info(fs.FileSelector(self.inner, allow_not_found=True, recursive=True))
        prefix = self.path[: self.path.index(self.inner)] if self.inner in self.path else ""
        return {prefix + f.path: [f.size, f.mtime_ns // 1000] for f in found if f.is_file and fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_"))}

    def _last(self) -> int:
        found = self.kept.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return max((int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json")), default=0)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        last, now = self._last(), self._listing()
        if now == self._load(last):
            return {"snapshot": last}
        self.kept.create_dir(self.folder)
        new = f"{self.folder}/.{last + 1}"
        with self.kept.open_output_stream(new) as f:
            f.write(json.dumps(now).encode())
        self.kept.move(new, self._file(last + 1))
        return {"snapshot": last + 1}

    def partitions(self, start: dict, end: dict) -> list[Changes]:
        old, new = self._load(start["snapshot"]), self._load(end["snapshot"])
        rows = [(p, "removed", *old[p]) for p in old if p not in new]
        rows += [(p, "changed" if p in old else "added", *v) for p, v in new.items() if old.get(p) != v]
        rows = [(*r, end["snapshot"]) for r in sorted(rows)]
        return [Changes(rows[i : i + PART]) for i in range(0, len(rows), PART)] or [Changes([])]

    def read(self, partition: Changes) -> Iterator[tuple]:
        from datetime import datetime, timezone

        for path, change, size, micros, snapshot in partition.rows:
            yield path, change, size, datetime.fromtimestamp(micros / 1e6, timezone.utc), snapshot

    def commit(self, end: dict) -> None:
        for f in self.kept.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if f.base_name.endswith(".json") and int(f.base_name.removesuffix(".json")) < end["snapshot"]:
                self.kept.delete_file(f.path)
