"""Sessions with the settings the engine expects."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "tallyroom") -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster leave ``master`` and ``shuffle_partitions`` to it."""
    root = str(Path(__file__).resolve().parents[1])
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # Python workers import this package too
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master)
        if master.startswith("local") and "spark.driver.memory" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
            builder = builder.config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Lets Python workers of a session made elsewhere import this package from where the driver has it.  On a cluster
    ship the package with --py-files; a folder that executors do not have is passed over."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH")]))
