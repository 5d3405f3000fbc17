"""Session builder with the settings every Vellumine job expects."""
from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession


def build_session(app: str = "vellumine", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and Arrow on; on a cluster the submit-time settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": os.environ.get("VELLUMINE_UI", "false"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf).getOrCreate()


#: Used only where the session names no shared folder and all runs on one machine (tests).
LOCAL_FOLDER = "/tmp/checkpoints/vellumine"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on a cluster it has to be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (folder or LOCAL_FOLDER).rstrip("/")


def with_checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the shared folder, where no other was chosen before."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
