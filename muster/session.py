"""Session construction and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "muster", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where none is named, a scratch folder serves a session whose executors are threads of this process; on a
    cluster, whose machines would not see it, that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("name a folder that all machines share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="muster-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def use_utc(spark: SparkSession) -> None:
    """Instants are read and shown in UTC throughout the library."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path nobody has written to yet, below the shared work folder."""
    return f"{work_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
