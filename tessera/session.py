"""The session that the library is tested with, and its settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time zone and adaptive execution matter for results and plans; the rest of a cluster's settings are its own.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def session(master: str | None = None, name: str = "tessera", **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword names have _ for the dots of Spark's names."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
