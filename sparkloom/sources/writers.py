"""Sinks: corpora with summaries, indexes, catalogs, result and report files. All write through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Format versions.
WIRE_VERSION, FLOW_VERSION = "2.0-wire-enhanced", "1.0-payment-flow-index"


def save_corpus(rows: DataFrame, path: str, version: str = FLOW_VERSION, *by: str, mode: str = "overwrite") -> None:
    """Parquet below path/chunks and a one-row summary below path/summary."""
    writer = rows.withColumn("corpus_version", F.lit(version)).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(f"{path}/chunks")
    names = [F.array_sort(F.slice(F.array_sort(F.collect_set("name")), 1, 15)).alias("sample_names")] if "name" in rows.columns else []
    summary = rows.agg(F.lit(version).alias("version"), F.count("*").alias("total_chunks"), *names)
    summary.write.mode("overwrite").json(f"{path}/summary")


def save_catalog(rows: DataFrame, path: str) -> None:
    """The catalog in a new folder; readers of the old one are not disturbed until the caller switches."""
    rows.write.mode("overwrite").parquet(path)


def save_results(rows: DataFrame, path: str, calls: str = "function_calls", most: int = 5) -> None:
    """Search results as JSON with the first calls of each."""
    shown = rows.withColumn(calls, F.slice(calls, 1, most)) if calls in rows.columns else rows
    shown.write.mode("overwrite").json(path)


def save_text(rows: DataFrame, path: str, column: str = "text") -> None:
    """One text a line group, as text files."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def save_images(rows: DataFrame, path: str, vocabulary: list[str], kind: str = "binary") -> None:
    """Keyword vectors with their vocabulary and kind."""
    from ..operators import weights

    vector = weights.binary_vector(F.col("keywords"), vocabulary)
    rows.withColumn("keyword_vector", vector).withColumn("vector_type", F.lit(kind)).write.mode("overwrite").parquet(f"{path}/images")
    rows.sparkSession.createDataFrame([(i, w) for i, w in enumerate(vocabulary)], "idx int, term string").write.mode("overwrite").parquet(f"{path}/vocabulary")


def graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON for a viewer."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
