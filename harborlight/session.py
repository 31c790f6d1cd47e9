"""Session settings used by tests, the bench and stand-alone scripts."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(name: str = "harborlight", cores: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session with adaptive execution on and UTC time.

    On a cluster none of this is needed: operators read what they must know
    (shuffle partitions, checkpoint folder) from the session they are given.
    """
    return (
        SparkSession.builder.appName(name)
        .master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
