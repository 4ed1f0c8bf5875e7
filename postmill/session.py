"""Session construction shared by the entry point, the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every plan in this package relies on. Sizing (partitions, memory) is left to the
# cluster: AQE coalesces small shuffle partitions and splits skewed ones at run time.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, name: str = "postmill", **conf: str) -> SparkSession:
    """Return the active session, or build one with the package defaults."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
