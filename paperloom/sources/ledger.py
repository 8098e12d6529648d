"""Tables whose changes write only what changes, with a log of commits that several writers share.

A commit is a small file with a number, put in place only if none with that number is there, as the last thing that a write does. It lists what makes up the table:
leaf folders of rows (one for each partition value) and of marks (keys of rows that are gone), each with the number of the commit that brought it. A mark hides
the rows of its key that came before it. So a deletion writes marks, an update marks and new rows, and a deleted partition is left out of the list: no file is rewritten
and no other partition is touched. ``compact`` rewrites the partitions that have marks or many folders, and those alone. A write that dies before its commit is not seen.

Writers work from the newest commit that they see. If another one comes first, they look at what it changed: changes of other partitions, or of key ranges apart from theirs,
are taken in and the commit is tried with the next number; else the change is worked out again on the newer table, so nothing is lost or done twice.

Rows are written in key order by range, with the least and greatest key of each file in an index and Parquet's bloom filters on the keys, so that ``lookup`` reads the files
that can hold a key and in them the row groups that do. Lists that reach the driver have a row a folder or a partition value, or the files of one lookup.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.store import append, first_wins, not_stored
from paperloom.schema import Table

NULL = "__HIVE_DEFAULT_PARTITION__"


class Conflict(RuntimeError):
    """Other writers changed the same keys at every try."""


@dataclass
class Change:
    """Rows to add, keys (or whole rows) to remove, and partition values that go altogether (None: none; "all": every one)."""

    add: DataFrame | None = None
    remove: DataFrame | None = None
    drop: list[str] | str | None = None


class Ledger:
    """Tables below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, tries: int = 20):
        self.spark, self.folder, self.tries = spark, folder.rstrip("/"), tries

    # The log

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, number: int) -> dict:
        path, system = self._path(name, "log", f"{number:012d}.json")
        stream = system.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self, name: str) -> int:
        """The number of the last commit; 0 if the table was never written."""
        path, system = self._path(name, "log")
        if not system.exists(path):
            return 0
        return max((int(s.getPath().getName()[:12]) for s in system.listStatus(path) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != "."), default=0)

    @staticmethod
    def _local(system) -> bool:
        return system.getUri().getScheme() == "file"

    def _put(self, name: str, number: int, state: dict) -> bool:
        """The commit, if none has its number yet."""
        jvm, body = self.spark.sparkContext._jvm, json.dumps(state)
        target, system = self._path(name, "log", f"{number:012d}.json")
        draft, _ = self._path(name, "log", f".{uuid.uuid4().hex}.draft")
        stream = system.create(draft, False)
        stream.write(body.encode())
        stream.close()
        if self._local(system):  # a link is made or refused in one step, a local rename is not
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                system.delete(draft, False)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            context.rename(draft, target, options)
            return True
        except Exception:
            if not system.exists(target):
                raise
            system.delete(draft, False)
            return False

    # Reading

    def _state(self, name: str, number: int | None = None) -> dict:
        number = self.version(name) if number is None else number
        return self._read(name, number) if number else {"number": 0, "rows": [], "marks": []}

    @staticmethod
    def _identity(table: Table) -> list[str]:
        """What tells rows apart: key and partition, or all columns of a table without a key."""
        return [*table.key, *[c for c in table.partition if c not in table.key]] if table.key else table.names

    def _rows(self, table: Table, state: dict, parts: set[str] | None = None) -> DataFrame:
        own = [f for f in state["rows"] if parts is None or f["part"] in parts]
        marks = [f for f in state["marks"] if parts is None or f["part"] in parts]
        marked = {f["part"] for f in marks}
        out = self.spark.createDataFrame([], table.schema)
        if plain := [f["path"] for f in own if f["part"] not in marked]:
            out = self._read_rows(table, plain)
        if mixed := [f for f in own if f["part"] in marked]:
            merged = self._merged(table, mixed, marks)
            out = out.unionByName(merged) if plain else merged
        return out

    def _read_rows(self, table: Table, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(table.schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def _numbered(self, frame: DataFrame, folders: list[dict], name: str) -> DataFrame:
        """With the number of the commit that brought each row, by its folder."""
        numbers = self.spark.createDataFrame(list({(f["path"].split("/")[1], f["number"]) for f in folders}), f"_folder string, {name} long")
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/([rm]-[0-9a-f]{32})/", 1)
        return frame.withColumn("_folder", folder).join(F.broadcast(numbers), "_folder").drop("_folder")  # a row a folder

    def _merged(self, table: Table, rows: list[dict], marks: list[dict]) -> DataFrame:
        """Rows that no later mark of their key hides."""
        key = self._identity(table)
        left = self._numbered(self._read_rows(table, [f["path"] for f in rows]), rows, "_number")
        schema = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in key)
        gone = self._numbered(self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f['path']}" for f in marks]), marks, "_gone")
        gone = gone.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.max("_gone").alias("_gone"))
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])
        return left.join(gone, same & (F.col("_number") < F.col("_gone")), "left_anti").select(*table.names)

    def scan(self, table: Table, part: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest one); of one partition value, only its folders are read."""
        return self._rows(table, self._state(table.name, version), None if part is None else {part})

    def lookup(self, table: Table, keys: DataFrame) -> DataFrame:
        """The rows whose first key column is among the keys (one column of that name): only files whose range holds a key are read, whatever the table's size."""
        name, state = table.key[0], self._state(table.name)
        wanted = keys.select(F.col(name).cast("string").alias("_k")).where("_k is not null").distinct()
        indexes = sorted({f["index"] for f in state["rows"]})
        if not indexes:
            return self.spark.createDataFrame([], table.schema)
        live = {f["path"] for f in state["rows"]}
        index = self.spark.read.schema("path string, low string, high string").parquet(*[f"{self.folder}/{p}" for p in indexes])
        hit = index.join(F.broadcast(wanted) if wanted.count() <= 1_000_000 else wanted, (F.col("_k") >= F.col("low")) & (F.col("_k") <= F.col("high")), "left_semi")
        files = [r["path"] for r in hit.select("path").collect() if r["path"].rsplit("/", 1)[0] in live]  # files of one lookup
        if not files:
            return self.spark.createDataFrame([], table.schema)
        parts = {f["path"]: f for f in state["rows"]}
        found = [parts[f.rsplit("/", 1)[0]] | {"path": f} for f in files]
        marks = [m for m in state["marks"] if m["part"] in {f["part"] for f in found}]
        marked = {m["part"] for m in marks}
        some = wanted.limit(11).collect()
        pushed = F.col(name).cast("string").isin([r["_k"] for r in some]) if len(some) <= 10 else F.lit(True)
        if len(some) <= 10 and table.schema[name].dataType.simpleString() == "string":
            pushed = F.col(name).isin([r["_k"] for r in some])  # reaches the bloom filters
        out = [self._read_rows(table, plain)] if (plain := [f["path"] for f in found if f["part"] not in marked]) else []
        out += [self._merged(table, mixed, marks)] if (mixed := [f for f in found if f["part"] in marked]) else []
        rows = reduce(DataFrame.unionByName, out).where(pushed)
        return rows.join(wanted, F.col(name).cast("string") == F.col("_k"), "left_semi")

    # Writing

    def _leaves(self, table: Table, frame: DataFrame, kind: str, names: list[str], indexed: bool) -> list[dict]:
        """Writes a folder of rows or marks, in key order, and lists its leaves by partition value."""
        identifier = f"{kind}-{uuid.uuid4().hex}"
        part = F.coalesce(F.col(table.partition[0]).cast("string"), F.lit(NULL)) if table.partition else F.lit("")
        out = frame.select(*names).withColumn("_part", F.when(part == "", F.lit(" ")).otherwise(part))
        first = [c for c in table.key[:1] if c in names]
        if first:
            out = out.repartitionByRange("_part", *first).sortWithinPartitions("_part", *first)
        writer = out.write.partitionBy("_part")
        for c in first:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.folder}/{table.name}/{identifier}")
        written = self.spark.read.schema(out.schema).parquet(f"{self.folder}/{table.name}/{identifier}")  # of no rows there is no file to tell the schema
        file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        written = written.withColumn("_path", F.regexp_extract(file, rf"({table.name}/{identifier}/.*)$", 1))
        key = F.col(first[0]).cast("string") if first else F.lit(None).cast("string")
        ranges = written.groupBy("_path").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        index = f"{table.name}/i-{uuid.uuid4().hex}"
        ranges.select(F.col("_path").alias("path"), "low", "high").write.parquet(f"{self.folder}/{index}")
        files = self.spark.read.parquet(f"{self.folder}/{index}").withColumn("leaf", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
        leaves = files.groupBy("leaf").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("files")).collect()  # a row a partition value
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return [{"path": r["leaf"], "part": unescape(r["leaf"].rsplit("_part=", 1)[1]), "index": index, "low": r["low"], "high": r["high"]} for r in leaves]

    @staticmethod
    def _meets(mine: dict, other: dict) -> bool:
        """Whether two changes touch the same keys."""
        if mine["whole"] or other["whole"]:
            a, b = set(mine["parts"] or []), set(other["parts"] or [])
            touched = lambda c: set(c["parts"] or []) | {r[0] for r in c["ranges"]}
            return mine["parts"] is None or other["parts"] is None or bool(a & touched(other) or b & touched(mine))
        if mine["blind"] and other["blind"]:
            return False  # rows of tables without a key are simply added
        unbounded = lambda r: r[1] is None or r[2] is None
        return any(x[0] == y[0] and (unbounded(x) or unbounded(y) or x[1] <= y[2] and y[1] <= x[2]) for x in mine["ranges"] for y in other["ranges"])

    def commit(self, table: Table, work: Callable[[DataFrame], Change], kind: str = "change") -> int:
        """Applies what ``work`` makes of the current rows; it is asked again if another writer changed the same keys meanwhile. Gives the commit's number."""
        for attempt in range(self.tries):
            base = self._state(table.name)
            change = work(self._rows(table, base))
            added = self._leaves(table, change.add, "r", table.names, True) if change.add is not None else []
            gone = self._leaves(table, change.remove, "m", self._identity(table), False) if change.remove is not None else []
            parts = None if change.drop == "all" else change.drop
            mine = {
                "kind": kind, "whole": change.drop is not None, "parts": parts, "blind": not table.key and change.remove is None,
                "ranges": [[f["part"], f["low"], f["high"]] for f in added + gone],
            }
            seen, number = base, base["number"]
            while True:
                number += 1
                dropped = (lambda f: True) if change.drop == "all" else (lambda f: f["part"] in (change.drop or ()))  # noqa: B023
                state = {
                    "number": number, "change": mine, "rows": [f for f in seen["rows"] if not dropped(f)] + [f | {"number": number} for f in added],
                    "marks": [f for f in seen["marks"] if not dropped(f)] + [f | {"number": number} for f in gone],
                }
                if not added and not gone and change.drop is None:
                    return base["number"]
                if self._put(table.name, number, state):
                    return number
                seen = self._read(table.name, number)
                if self._meets(mine, seen["change"]):
                    break  # worked out again on the newer table
            time.sleep(random.random() * 0.05 * (attempt + 1))
        raise Conflict(f"{table.name}: other writers changed the same keys {self.tries} times")

    def write(self, table: Table, rows: DataFrame) -> int:
        """These rows alone."""
        return self.commit(table, lambda _: Change(add=rows, drop="all"), "write")

    def add(self, table: Table, rows: DataFrame) -> int:
        """These rows besides the current ones."""
        return self.commit(table, lambda _: Change(add=rows), "add")

    def insert(self, table: Table, rows: DataFrame, order_by: list[str | Column]) -> int:
        """Rows whose key the table lacks; the first row of a key in the batch wins."""
        key = list(table.key)
        fresh = lambda old: not_stored(first_wins(rows, key, order_by), old, key) if key else rows
        return self.commit(table, lambda old: Change(add=append(old.limit(0), fresh(old).select(*[c for c in table.names if c in rows.columns]))), "insert")

    def _changed(self, table: Table, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], kind: str) -> DataFrame:
        key, base = [c for c in table.key if c in changes.columns], {}

        def work(old: DataFrame) -> Change:
            base["rows"] = old.join(changes.select(*key), key, "left_semi").select(*table.names)
            return Change(add=merge(base["rows"], changes), remove=base["rows"])

        self.commit(table, work, kind)
        return base["rows"]

    def update(self, table: Table, changes: DataFrame) -> DataFrame:
        """Non-null values of the changes overwrite; unknown keys are ignored. Keys of the changes are unique. Gives the rows as they were."""
        from paperloom.operators import store

        return self._changed(table, changes, lambda rows, new: store.update(rows, new, [c for c in table.key if c in new.columns]), "update")

    def replace(self, table: Table, changes: DataFrame) -> DataFrame:
        """Whole rows are replaced; unknown keys are ignored. Gives the rows as they were."""
        key = list(table.key)
        return self._changed(table, changes, lambda rows, new: append(rows.limit(0), new.join(rows.select(*key).distinct(), key, "left_semi")).select(*table.names), "replace")

    def delete(self, table: Table, keys: DataFrame) -> DataFrame:
        """Removes the rows at the keys (any columns); gives them."""
        base = {}

        def work(old: DataFrame) -> Change:
            base["rows"] = old.join(keys.distinct(), keys.columns, "left_semi").select(*table.names)
            return Change(remove=base["rows"])

        self.commit(table, work, "delete")
        return base["rows"]

    def delete_partition(self, table: Table, value: str) -> DataFrame:
        """Removes all rows of a partition value without writing a file but the commit; gives them."""
        before = self.scan(table, value)
        self.commit(table, lambda _: Change(drop=[value]), "delete partition")
        return before

    def compact(self, table: Table, most: int = 16) -> list[str]:
        """Rewrites the partition values that have marks or more than ``most`` folders, and no others; gives them."""
        state = self._state(table.name)
        counts: dict[str, int] = {}
        for f in state["rows"]:
            counts[f["part"]] = counts.get(f["part"], 0) + 1
        stale = sorted({f["part"] for f in state["marks"]} | {p for p, n in counts.items() if n > most})
        if stale:

            def work(_: DataFrame) -> Change:
                return Change(add=self._rows(table, self._state(table.name), set(stale)), drop=stale)

            self.commit(table, work, "compact")
        return stale
