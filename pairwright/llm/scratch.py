"""Durable intermediate tables.

Lineage is cut by writing a Parquet table below the folder that the cluster names in
``spark.checkpoint.dir``; every executor and the driver see it, so a lost executor costs
at most the tasks it was running.  Only where the setting is absent and everything runs in one
process (unit tests) a local folder is made and announced as checkpoint folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; one is made only if none is configured and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="pairwright-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """A folder for one operator call.  Tables go when dropped or when Python ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/pairwright/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` and read it back: the lineage ends here."""
        schema = df.schema
        self.names.add(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no live DataFrame reads any more."""
        for name in names:
            self._delete(self.path(name))
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Delete all tables but those that the result reads."""
        self.drop(*(self.names - set(names)))

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            pass
