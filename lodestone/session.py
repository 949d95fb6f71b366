"""Session construction for tests, benchmarks and local runs.

On a cluster the caller brings its own session; operators only read settings.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "lodestone", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A UTC session on ``local[cores]`` with adaptive execution."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
