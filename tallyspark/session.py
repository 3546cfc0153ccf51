"""The session the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tallyspark", **settings: str) -> SparkSession:
    """UTC, ANSI, adaptive execution; the master and sizes come from the cluster or ``settings``."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=fixed | settings).getOrCreate()
