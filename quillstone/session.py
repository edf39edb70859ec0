"""Session factory with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "quillstone", master: str | None = None, **extra: str) -> SparkSession:
    """A session in UTC with AQE and Arrow on; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    conf.update({k.replace("__", "."): v for k, v in extra.items()})
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
