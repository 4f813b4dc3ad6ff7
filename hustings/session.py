"""Spark session defaults and the shared scratch location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "hustings", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC dates and adaptive execution; on a cluster the submit-time settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage and written tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests on one
    machine) a temporary folder is made and remembered for the session; on a cluster it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        configured = tempfile.mkdtemp(prefix="hustings-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused, so no earlier run is overwritten."""
    return os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df, name: str = "settled"):
    """``df`` written once to the shared folder and read again, so that Spark knows its real size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df):
    """Materialise ``df`` once in the reliable shared folder (survives lost executors)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
