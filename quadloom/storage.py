"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "_quadloom_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quadloom-shared-")
        spark.sparkContext._quadloom_shared = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage, survive lost executors, and go when dropped or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def table(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            for t in [self.path(t) for t in tables] or [self.base]:
                p = jvm.org.apache.hadoop.fs.Path(t)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return
