"""A Spark session with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, checkpoint: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and a shared folder for tables that cut lineage; anything else as the cluster has it."""
    builder = SparkSession.builder.appName("strandweave")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    if master:
        settings |= {"spark.master": master}
        if master.startswith("local"):
            settings |= {"spark.ui.enabled": "false", "spark.driver.memory": "8g"}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    if checkpoint:
        settings["spark.checkpoint.dir"] = checkpoint
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
