"""Session builder and the settings every plan here relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "glossweave", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer on.

    ``conf`` overrides any default, with ``_`` for ``.`` in its names.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
