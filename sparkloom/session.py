"""Session with the settings the library is tuned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "sparkloom", cores: int | None = None) -> SparkSession:
    """A local session; on a cluster pass your own session to the functions instead."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
