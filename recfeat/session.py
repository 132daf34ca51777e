"""Session settings the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "recfeat", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with UTC time, adaptive execution and skew-join handling switched on.

    ``conf`` overrides any default.  On a cluster leave ``master`` unset and size
    ``spark.sql.shuffle.partitions`` by the input (AQE coalesces what turns out to be small).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": os.environ.get("RECFEAT_UI", "false"),
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
