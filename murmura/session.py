"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "murmura", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings given by the cluster or in ``conf`` take precedence."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**settings, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
