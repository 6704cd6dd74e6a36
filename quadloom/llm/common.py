"""Shared plumbing of the training-data operators: shared storage, shipping the package to executors, clash-free columns."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Where the public tokenizer vocabularies lie; every operator that needs one takes the file's path as a parameter.
DEFAULT_BPE = "byte_bpe_50k.json"


def vocabulary(name: str = DEFAULT_BPE) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_quadloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quadloom-")) / "quadloom_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(to))
    sc._quadloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; one of our own only where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_quadloom_shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quadloom-shared-")
        spark.sparkContext._quadloom_shared = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder: cut lineage, survive lost executors, go when dropped or when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/quadloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def table(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def release(self) -> None:
        """Shuffle files of finished jobs go when the driver's references to them are collected; loops ask for that, else disks fill."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            for t in [self.path(t) for t in tables] or [self.base]:
                p = jvm.org.apache.hadoop.fs.Path(t)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case."""
    taken, out = {c.lower() for c in docs.columns}, f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def utf8(column) -> list[bytes]:
    """An Arrow string column as bytes; null becomes empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
