"""The session that tests, the bench and ad-hoc runs share; a cluster's own session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "quern", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution. On a cluster, spark-submit's settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[*]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    }
    session = builder.config(map=defaults | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
