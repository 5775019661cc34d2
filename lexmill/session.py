"""SparkSession factory with the settings the engine is written for."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "lexmill", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer; conf adds or overrides settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one in the warehouse, which all executors share."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder that nothing else uses, where all executors can read and write."""
    return f"{checkpoint_folder(spark).rstrip('/')}/lexmill/{label}-{uuid.uuid4().hex}"
