"""SparkSession factory with the settings every plan in the library assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "corvina", master: str | None = None, **conf: str) -> SparkSession:
    """An AQE session in UTC; ``master`` only applies when none is configured by spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("CORVINA_SHUFFLE_PARTITIONS", "8"),
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver runs from.

    On a cluster the package is shipped with the job; the extra path is then ignored.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
