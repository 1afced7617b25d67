"""Session builder with the defaults that the verbs' semantics rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots written as double underscores."""
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        b = b.master(master or os.environ["SPARK_MASTER"])
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
