"""A session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "mergelens", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and dynamic partition overwrite; ``conf`` adds to these.

    The master is left to the deployment unless given. Dots in option names are written as
    double underscores: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
