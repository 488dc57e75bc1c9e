"""Session factory with the settings every operator here is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results or plans; sizes of partitions are left to AQE.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(app: str = "ledgerloom", cpus: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests, the bench and the command line; on a cluster spark-submit brings its own master and memory."""
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.appName(app).config(map=SETTINGS).config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.driver.memory", memory)
    return builder.master(os.environ.get("SPARK_MASTER", f"local[{cpus}]")).getOrCreate()
