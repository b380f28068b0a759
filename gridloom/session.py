"""A Spark session with the settings that the library's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI on, UTC, AQE with skew joins; partition counts are left to the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (fixed | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
