"""A Spark session with the settings that the engine's plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC keeps timestamps comparable; adaptive execution sizes and splits shuffles at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "assayer", **more: str) -> SparkSession:
    """The running session, or a new one with ``SETTINGS`` and the given ones."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
