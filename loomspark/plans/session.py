"""Session settings that suit both a laptop and a cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "loomspark", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE with coalescing and skew joins; on a cluster, partitions stay at what the cluster sets."""
    b = SparkSession.builder.appName(name)
    b = b.master(master) if master else b
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
