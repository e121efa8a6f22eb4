"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that keep plans adaptive and times in UTC; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session under SETTINGS; ``settings`` have dots written as double underscores."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()
