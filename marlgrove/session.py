"""A session with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "marlgrove", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """UTC, adaptive execution with skew joins, and as many shuffle partitions as asked for."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
