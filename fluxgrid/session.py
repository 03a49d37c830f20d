"""A session with the settings that the operators expect; on a cluster, set the same ones there."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "fluxgrid", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf overrides (dots as double underscores)."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=base | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
