"""The session that the package's own scripts and tests run in."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with ANSI casts, UTC and adaptive execution; Python workers find this repository on its own path."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(master).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark
