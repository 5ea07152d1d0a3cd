"""Incremental document catalog: three-way difference, upsert, status."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx


def fingerprint(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """name, hash (MD5), size in bytes."""
    return files.select(F.col(name).alias("name"), F.md5(F.col(content).cast("binary")).alias("hash"), F.octet_length(content).alias("size"))


def diff(catalog: DataFrame, current: DataFrame, keep_modified: bool = False) -> DataFrame:
    """name, status: new, modified (hash or modified_time differs), removed, or same."""
    old = catalog.select("name", F.col("hash").alias("old_hash"), *([F.col("modified").alias("old_modified")] if keep_modified else []))
    both = old.join(current, "name", "full_outer")
    changed = F.col("hash") != F.col("old_hash")
    if keep_modified:
        changed = changed | (F.col("modified") != F.col("old_modified"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("hash").isNull(), "removed").when(changed, "modified").otherwise("same")
    return both.select("name", status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, changes: DataFrame, key: str = "name", keep_removed: bool = False) -> DataFrame:
    """Old rows of documents that weren't indexed again, and all new rows. Rows of removed documents go too, unless kept."""
    gone = ["new", "modified"] if keep_removed else ["new", "modified", "removed"]
    touched = changes.where(F.col("status").isin(*gone)).select(F.col("name").alias(key))
    return old.join(touched, key, "left_anti").unionByName(new)


def upsert_one(old: DataFrame, new: DataFrame, key: str = "name") -> DataFrame:
    """Replaces the rows of the documents that `new` has."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def status(changes: DataFrame) -> DataFrame:
    """One row: counts by status, and whether anything needs an update."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return changes.agg(n("new"), n("modified"), n("removed"), n("same"), (F.count_if(F.col("status") != "same") > 0).alias("needs_update"))


def chunk_counts(rows: DataFrame, key: str = "name") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("chunks_count"))


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns are added and nulls filled."""
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()})


def corpora(named: dict[str, DataFrame]) -> DataFrame:
    """Union of corpora with corpus_source and corpus_index; columns that one lacks are null."""
    out = None
    for i, (name, rows) in enumerate(named.items()):
        part = rows.withColumn("corpus_source", F.lit(name)).withColumn("corpus_index", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def embed(rows: DataFrame, provider=None, size: int = 64, text: str = "content") -> DataFrame:
    """Adds `embedding`. provider: a function from a list of texts to a list of vectors, called by batches of 32; the
    default hashes words into `size` buckets, in the JVM."""
    if provider is None:
        buckets = F.transform(fx.words_of(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
        # sorted with one mark for each bucket and one behind them, so that a bucket's words are what lies between two marks
        marked = F.sort_array(F.concat(buckets, F.sequence(F.lit(0).cast("long"), F.lit(size).cast("long"))))
        count = lambda held, i: F.array_position(held, i + 1) - F.array_position(held, i) - 1
        spots = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
        vector = F.get(F.transform(F.array(marked), lambda held: F.transform(spots, lambda i: count(held, i).cast("float"))), F.lit(0))
        return rows.withColumn("embedding", vector)

    @F.pandas_udf("array<float>")
    def made(texts: pd.Series) -> pd.Series:
        held = []
        for k in range(0, len(texts), 32):
            held += [list(map(float, v)) for v in provider(list(texts[k : k + 32]))]
        return pd.Series(held)

    return rows.withColumn("embedding", made(text))


def summary(text) -> object:
    """The first two sentences: the offline stand-in for a model's summary."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?])\s+"), 1, 2), " ")
