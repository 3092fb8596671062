"""Session builder with the settings the library is planned for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "spanlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; `conf` uses `_` for `.`-free extras.

    Shuffle partitions follow the cores here; on a cluster leave them to
    adaptive coalescing from a high initial count.
    """
    cores = os.environ.get("BENCH_CPUS", "8")
    b = (
        SparkSession.builder.appName(app)
        .master(master or f"local[{cores}]")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPANLENS_DRIVER_MEMORY", "12g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
