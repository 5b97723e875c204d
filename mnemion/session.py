"""A session with the settings that the library is meant to run with. On a cluster, spark-submit's own settings hold."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "mnemion", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    return builder.config(map=settings | conf).getOrCreate()
