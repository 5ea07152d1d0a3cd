"""Incremental indexing: new and changed files of a folder are chunked and put into a table, batch by batch.

A table is two logs of folders batch=N: `documents`, a row for each document that the batch indexed or found removed
(source_file, hash, removed), and `chunks`, their chunks. A document counts as its last row in `documents` says, so one
that became blank or was removed has no chunks. The chunks of a batch are written before its documents, so a batch that
breaks off is not seen.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import catalog, chunking

DOCUMENTS = "source_file string, hash string, removed boolean, batch bigint"


def _chunks(rows: DataFrame) -> DataFrame:
    return chunking.chunks(rows, None, 100, "source_file", "content")


def _name(path, root: str):
    """A file's path below the folder that is indexed."""
    bare = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/", root).rstrip("/")
    return F.regexp_replace(path, rf"^.*?\Q{bare}\E/+", "")


def file_stream(spark: SparkSession, path: str, pattern: str = "*.txt", files_each: int = 1000) -> DataFrame:
    """source_file (its path below the folder), content of files as they arrive. Spark's file stream gives a path once, so files of a
    versioned name are read again after a change, and others only by index_changes()."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_each).option("recursiveFileLookup", "true").schema("value string").load(path)
    return rows.select(_name(F.input_file_name(), path).alias("source_file"), F.col("value").alias("content"))


def put(batch: DataFrame, removed: DataFrame | None, table: str, number: int, chunker: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes a batch of documents (source_file, content) and of names removed; again under its number, it replaces itself."""
    (chunker or _chunks)(batch).write.mode("overwrite").parquet(f"{table}/chunks/batch={number}")
    held = batch.select("source_file", F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("hash"), F.lit(False).alias("removed"))
    if removed is not None:
        held = held.unionByName(removed.select("source_file", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("removed")))
    held.write.mode("overwrite").parquet(f"{table}/documents/batch={number}")


def index_stream(files: DataFrame, table: str, checkpoint: str, chunker: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Puts what a stream of files brings; a batch that is retried replaces its own folders. Runs until the input is used up."""

    def each(batch: DataFrame, number: int) -> None:
        put(batch, None, table, number, chunker)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def documents(spark: SparkSession, table: str) -> DataFrame:
    """source_file, hash, batch of the documents that are there, by the last batch that names them."""
    try:
        rows = spark.read.schema(DOCUMENTS).option("basePath", f"{table}/documents").parquet(f"{table}/documents/batch=*")
    except AnalysisException:
        return spark.createDataFrame([], "source_file string, hash string, batch bigint")
    last = rows.groupBy("source_file").agg(F.max_by(F.struct("hash", "removed"), "batch").alias("d"), F.max("batch").alias("batch"))
    return last.where("not d.removed").select("source_file", "d.hash", "batch")


def index_changes(spark: SparkSession, path: str, table: str, pattern: str = "*.txt", chunker: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, int]:
    """Puts the files of the folder whose fingerprints differ from the table's as a batch, and the names of those gone.

    Returns how many are new, modified and removed; without any, no batch is written. The files' contents are read once
    for the fingerprints and once more for those that changed.
    """
    rows = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").schema("value string").load(path)
    files = rows.select(_name(F.input_file_name(), path).alias("source_file"), F.col("value").alias("content"))
    known = documents(spark, table).select(F.col("source_file").alias("name"), "hash")
    changes = catalog.diff(known, catalog.fingerprint(files, "source_file", "content"))
    found = {r.status: r["count"] for r in changes.where("status <> 'same'").groupBy("status").count().collect()}
    if found:
        named = lambda *kinds: changes.where(F.col("status").isin(*kinds)).select(F.col("name").alias("source_file"))
        put(files.join(named("new", "modified"), "source_file", "left_semi"), named("removed"), table, _next(spark, table), chunker)
    return {k: found.get(k, 0) for k in ("new", "modified", "removed")}


def _next(spark: SparkSession, table: str) -> int:
    try:
        rows = spark.read.schema(DOCUMENTS).option("basePath", f"{table}/documents").parquet(f"{table}/documents/batch=*")
    except AnalysisException:
        return 0
    return (rows.agg(F.max("batch")).first()[0] or 0) + 1


def current(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of the documents that are there, each of its last batch."""
    rows = spark.read.option("basePath", f"{table}/chunks").parquet(f"{table}/chunks/batch=*")
    return rows.join(documents(spark, table).select("source_file", "batch"), ["source_file", "batch"], "left_semi")


def compacted(spark: SparkSession, table: str, path: str) -> None:
    """A table elsewhere that holds what is current as its batch 0."""
    current(spark, table).drop("batch").write.parquet(f"{path}/chunks/batch=0")
    documents(spark, table).select("source_file", "hash", F.lit(False).alias("removed")).write.parquet(f"{path}/documents/batch=0")


def refreshed(spark: SparkSession, table: str, known: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a diff of fingerprints: the chunks without those of removed documents, and the new catalog."""
    changes = catalog.diff(known, now)
    gone = changes.where("status = 'removed'").select(F.col("name").alias("source_file"))
    return current(spark, table).join(gone, "source_file", "left_anti"), now
