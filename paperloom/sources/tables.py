"""Tables as Parquet snapshots: a folder for each complete version, and one for each addition to it.

A folder counts once Spark has put its ``_SUCCESS`` file there, the last thing that a write does. So a write that dies leaves nothing
that a reader sees or a later write meets; there is no pointer to move, and no path is overwritten while it is read.
The current rows are those of the newest version and of the additions since. All files go through Spark's own file systems.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from paperloom.schema import Table

_FOLDER = re.compile(r"([va])(\d+)-[0-9a-f]{32}")


class Snapshots:
    """Versions of tables below a folder that driver and executors share. A table has one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _complete(self, name: str) -> list[tuple[int, str, str]]:
        """(number, kind, path) of the complete folders: versions (v) and additions (a), in order."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = []
        for status in system.listStatus(path):
            if m := _FOLDER.fullmatch(status.getPath().getName()):
                done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
                if system.exists(done):
                    found.append((int(m[2]), m[1], status.getPath().toString()))
        return sorted(found)

    def _current(self, name: str) -> list[str]:
        """Folders of the newest version and of what was added since."""
        found = self._complete(name)
        start = max((i for i, (_, kind, _) in enumerate(found) if kind == "v"), default=0)
        return [path for _, _, path in found[start:]]

    def version(self, name: str) -> int:
        """The number of the last complete write; 0 if the table was never written."""
        return max((number for number, _, _ in self._complete(name)), default=0)

    def scan(self, table: Table) -> DataFrame:
        """The current rows with the table's types; an empty table if there are none."""
        rows = self.spark.createDataFrame([], table.schema)
        for i, path in enumerate(self._current(table.name)):
            part = self.spark.read.schema(table.schema).parquet(path).select(*table.names)
            rows = rows.unionByName(part) if i else part
        return rows

    def _write(self, kind: str, table: Table, rows: DataFrame) -> int:
        number = self.version(table.name) + 1
        rows.select(*table.names).write.partitionBy(*table.partition).parquet(f"{self.folder}/{table.name}/{kind}{number}-{uuid.uuid4().hex}")
        return number

    def write(self, table: Table, rows: DataFrame) -> int:
        """A new version with these rows alone, partitioned as the table is."""
        return self._write("v", table, rows)

    def add(self, table: Table, rows: DataFrame, most: int = 64) -> int:
        """These rows besides the current ones, of which nothing is rewritten until there are ``most`` additions."""
        number = self._write("a", table, rows)
        return self.write(table, self.scan(table)) if len(self._current(table.name)) > most else number
