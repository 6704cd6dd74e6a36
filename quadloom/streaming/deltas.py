"""Quad files that keep arriving, appended to a stored graph exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadloom.sources import nquads
from quadloom.store import GraphStore


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000, on_error: str = "fail") -> DataFrame:
    """(s, p, o, l) of N-Quads files as they come."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return nquads.parsed(lines, on_error=on_error)


def appended(spark: SparkSession, folder: str, to: str, checkpoint: str, files_per_batch: int = 1000, trigger: dict | None = None) -> StreamingQuery:
    """Each batch is a folder of its own under `to`, rewritten as a whole if it is run again; read it back with `stored`."""

    def put(batch: DataFrame, n: int) -> None:
        batch.dropDuplicates(["s", "p", "o", "l"]).write.mode("overwrite").parquet(f"{to}/batch={n}")

    return arriving(spark, folder, files_per_batch).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def stored(spark: SparkSession, to: str) -> GraphStore:
    quads = spark.read.schema("s string, p string, o string, l string, batch int").parquet(to)
    return GraphStore(quads.select("s", "p", "o", "l").distinct())


def counts(quads: DataFrame) -> DataFrame:
    """Running number of quads per predicate, for a stream in update or complete mode."""
    return quads.groupBy("p").agg(F.count("*").alias("n"))
