"""Session defaults for tests, benchmarks and scripts. A cluster's own settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "weftline", cores: int | str | None = None, shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session; ``conf`` overrides any default (dots written as ``__``)."""
    cores = cores or os.environ.get("WEFTLINE_CORES", "*")
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g"}
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    spark = b.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
