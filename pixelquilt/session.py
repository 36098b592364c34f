"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "pixelquilt", master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on and UTC time; sizes stay with the cluster's own settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({key.replace("__", "."): str(value) for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset, one machine alone takes a folder of its own; on a cluster, whose executors would not see it,
    it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir() + "/pixelquilt"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
