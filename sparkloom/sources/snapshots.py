"""Versioned tables that change together: snapshot files name the folders of every table, and publishing one is the commit.

A store is a folder: data/ has the written folders, versions/ a snapshot file a version. A commit writes its folders first and then creates the
next snapshot file, which fails if another writer has created it; so readers see all tables of a version or none, and keep reading theirs
while later ones are written. An upsert writes the new rows and the keys that they replace; reading drops rows whose key was replaced or removed later.
Compaction rewrites a table in the same store as a version of its own; vacuum deletes what the newest versions don't name.

Works on any file system that Spark writes to and that can create a file only if it isn't there. Defined cases: a table that isn't
in a version can't be read; null keys are replaced by null keys; an unfinished snapshot file is ignored by readers and removed by repair().
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit came first; nothing of this one is seen."""


@dataclass
class Replace:
    """All rows of a table. sort: columns by which its files are ranged, for searches that filter by them."""

    rows: DataFrame
    sort: tuple[str, ...] = ()


@dataclass
class Upsert:
    """Rows that replace those of their keys; gone: keys to remove."""

    rows: DataFrame
    key: str
    gone: DataFrame | None = None
    sort: tuple[str, ...] = ()


SEQ = "__version"


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._bytes = jvm.java.io.ByteArrayOutputStream

    def _snapshot(self, version: int) -> str:
        return f"{self.root}/versions/{version:010d}.json"

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, version: int) -> dict | None:
        held, stream = self._bytes(), self._fs.open(self._path(self._snapshot(version)))
        self._io.copyBytes(stream, held, 65536, True)
        try:
            return json.loads(held.toString("UTF-8"))
        except ValueError:
            return None

    def snapshot(self, version: int | None = None) -> dict:
        """The newest whole snapshot, or that of a version."""
        for n in reversed(self._numbers()) if version is None else [version]:
            if (found := self._load(n)) is not None:
                return found
        return {"version": 0, "tables": {}}

    def version(self) -> int:
        return self.snapshot()["version"]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of a table. Without replaced keys it is a plain scan, of the columns that are asked for."""
        held = self.snapshot(version)["tables"][table]
        schema = T.StructType.fromJson(held["schema"])
        own = T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())])
        rows = self.spark.read.schema(own).parquet(*held["parts"])
        if held["gone"]:
            key = held["key"]
            gone = self.spark.read.schema(T.StructType([T.StructField("__key", schema[key].dataType), T.StructField(SEQ, T.LongType())])).parquet(*held["gone"])
            last = gone.groupBy("__key").agg(F.max(SEQ).alias("__last"))
            rows = rows.join(last, rows[key].eqNullSafe(last["__key"]), "left").where(F.col("__last").isNull() | (F.col(SEQ) >= F.col("__last")))
        return rows.select(schema.names)

    def _write(self, rows: DataFrame, table: str, version: int, sort: tuple[str, ...] = ()) -> str:
        path = f"{self.root}/data/{table}-{uuid.uuid4().hex}"
        marked = rows.withColumn(SEQ, F.lit(version).cast("long"))
        (marked.repartitionByRange(*sort).sortWithinPartitions(*sort) if sort else marked).write.parquet(path)
        return path

    def commit(self, changes: dict[str, Replace | Upsert], base: int | None = None) -> int:
        """Writes the changes of all tables and publishes them as the next version. base: the version that they were made from, the newest if None."""
        before = self.snapshot(base)
        version, tables = before["version"] + 1, dict(before["tables"])
        for name, change in changes.items():
            held = tables.get(name)
            schema = json.loads(change.rows.schema.json())
            if isinstance(change, Replace):
                tables[name] = {"schema": schema, "key": None, "parts": [self._write(change.rows, name, version, change.sort)], "gone": []}
                continue
            if held and held["schema"] != schema and [f["name"] for f in held["schema"]["fields"]] != change.rows.columns:
                raise ValueError(f"{name} has other columns")
            keys = change.rows.select(F.col(change.key).alias("__key"))
            if change.gone is not None:
                keys = keys.unionByName(change.gone.select(F.col(change.key).alias("__key")))
            part = self._write(change.rows, name, version, change.sort)
            gone = [self._write(keys.distinct(), f"{name}-gone", version)] if held else []
            tables[name] = {"schema": schema, "key": change.key, "parts": [*(held["parts"] if held else []), part], "gone": [*(held["gone"] if held else []), *gone]}
        self._publish({"version": version, "tables": tables})
        return version

    def _publish(self, snapshot: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        if self._numbers()[-1:] >= [snapshot["version"]]:
            raise Conflict(f"version {snapshot['version']} is there")
        try:
            out = self._fs.create(self._path(self._snapshot(snapshot["version"])), False)
        except Exception as e:
            raise Conflict(f"version {snapshot['version']} is there") from e
        writer = jvm.java.io.OutputStreamWriter(out, "UTF-8")
        writer.write(json.dumps(snapshot))
        writer.close()

    def compact(self, table: str, sort: tuple[str, ...] = ()) -> int:
        """Rewrites a table without its replaced rows, as a version."""
        base = self.version()
        return self.commit({table: Replace(self.read(table, base), sort)}, base)

    def repair(self) -> None:
        """Removes a newest snapshot file that its writer didn't finish. Only when no writer runs."""
        for n in reversed(self._numbers()):
            if self._load(n) is not None:
                return
            self._fs.delete(self._path(self._snapshot(n)), False)

    def vacuum(self, keep: int = 2, older_than_ms: int = 86_400_000) -> int:
        """Deletes snapshots but the newest `keep`, and data folders that none of those names and that are older than the given
        age, so that what a running commit has written stays. Returns how many folders went."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._snapshot(n)), False)
        named = {p.rsplit("/", 1)[1] for n in numbers[-keep:] if (s := self._load(n)) for t in s["tables"].values() for p in [*t["parts"], *t["gone"]]}
        folder, now, count = self._path(f"{self.root}/data"), self.spark.sparkContext._jvm.java.lang.System.currentTimeMillis(), 0
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.getPath().getName() not in named and now - status.getModificationTime() >= older_than_ms:
                self._fs.delete(status.getPath(), True)
                count += 1
        return count
