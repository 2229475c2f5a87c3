"""Sessions and logging."""

from __future__ import annotations

import tempfile
import uuid

import logging

from pyspark.sql import SparkSession

LOG = logging.getLogger("pairwright")


def session(name: str = "pairwright", threads: int | None = None, log_level: str = "WARN", **conf: str) -> SparkSession:
    """A session as the engine wants it: adaptive execution on, UTC, Arrow; `threads` caps a local master only.

    An existing session is returned as it is, but for its log level.
    """
    builder = SparkSession.builder.appName(name)
    if threads is not None:
        builder = builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", str(threads))
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(log_level)
    LOG.setLevel({"OFF": logging.CRITICAL + 1, "FATAL": logging.CRITICAL, "WARN": logging.WARNING, "TRACE": logging.DEBUG, "ALL": logging.DEBUG}.get(log_level, log_level))
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that all machines share.

    That is `spark.checkpoint.dir`; only where it is unset and everything runs in one process, a local one is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="pairwright-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/pairwright/{name}-{uuid.uuid4().hex}"
