"""Cutting the lineage of iterative plans in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir; one of our own only where none is set, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def place(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint()
