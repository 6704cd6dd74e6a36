"""Exact dedup as a stateful stream.

Texts are equal if they are identical after deleting every character of `[\\x20\\x09-\\x0D]`. Of equal texts the row with the most code points
stays, then the smallest id (null last), then the first place.

Method. Every row's digest, stable identifier (its id, its length) and content locator (a hash of its file's path, its row in the
file) are written to the shared folder and read back as a stream. Streaming aggregation keeps, keyed by digest, in a RocksDB state
store without watermark, so without expiry, the row that stays and the number of rows; its checkpoints lie in the shared folder. A
long input is many micro-batches (`files_per_batch`), each leaving the changed keys, of which the last counts. `decided` takes what is
there and ends; a `Deduplicator` keeps state and contents in a folder of the caller's and judges each delivery against all former ones.

A digest is not believed: the bytes of each hit are checked against those of the row that stays, which the locator finds. If some
differ (never with SHA-256; tests weaken the digest), the rows of those digests are grouped again by their whole text (a `Deduplicator` stops
with an error instead).

Skew: keys are pre-aggregated before their shuffle, so a hot digest is a row per task. Digests that hold more than a thousandth of all
rows, fewer than a thousand therefore, are broadcast, and their rows are dealt to many tasks, each with a copy of the text that stays.

Cases: null text counts as empty, empty texts are equal to each other; repeated rows (equal ids too) are rows of one group, of which
one is kept; an empty table gives an empty result; further columns, whatever their names, are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import Scratch, fresh

WHITE = " \t\n\x0b\x0c\r"
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Disk is taken as it is filled: else each of many small stores has megabytes set aside
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Digests with more than this share of all rows are dealt to several tasks; there are fewer of them.
HOT = 1000
_BEST = ["short", "no_id", "id", "file", "at"]


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _plain(docs: DataFrame) -> bool:
    """Does docs only project and filter one set of files, so that a place in a file is one row?"""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    try:
        return plan.nodeName() == "LogicalRelation" and plan.relation().location().rootPaths().size() == 1
    except Exception:  # noqa: BLE001  whatever else is no plain scan
        return False


def located(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str, str]:
    """docs with two more columns, whose names follow, that find each row's content again. Rows that are not a plain scan of files are
    written first: after joins, unions or generators several rows may come from one place."""
    file, at = (fresh(docs, c) for c in ("file", "at"))
    if _plain(docs):
        try:
            if "_metadata" not in docs.columns:
                return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)), file, at
        except AnalysisException:
            pass
    stored = scratch.table(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), "stored")
    return stored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)), file, at


def _digested(docs, file, at, id_col, text_col, digest) -> tuple[DataFrame, DataFrame]:
    """Rows with their normalised texts, and what of them goes into the stream."""
    text = docs[text_col]
    told = docs.select(docs[id_col].alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("long"), F.col(file).alias("file"), F.col(at).alias("at"), normalised(text).alias("norm"))
    narrow = told.select(digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("sha"), (-F.col("long")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "file", "at")
    return told, narrow


def streamed_groups(spark, schema, base: str, files_per_batch: int) -> DataFrame:
    """(digest, group_size, best) of all tables ever written below `base`/digests, by a stateful streaming query that ends with its input."""
    old = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/digests")
        state = stream.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(F.struct(*_BEST)).alias("best"))
        query = (
            state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
            .foreachBatch(lambda changed, n: changed.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{base}/changed/part{n}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.schema.add("batch", "long")
    try:
        table = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{base}/changed")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], schema).drop("batch")
    if (query.lastProgress or {}).get("batchId", 1) == 0:
        return table.drop("batch")
    return table.groupBy("digest").agg(F.max_by(F.struct("group_size", "best"), "batch").alias("s")).select("digest", "s.*")


class _Dealt:
    """Joins on digest that deal the rows of hot digests to several tasks."""

    def __init__(self, groups: DataFrame, rows: int, scratch: Scratch):
        share = max(rows // HOT, 1000)
        hot = groups.where(F.col("group_size") > share).select("digest", F.ceil(F.col("group_size") / share).cast("int").alias("salts"))
        self.hot = F.broadcast(scratch.table(hot, "hot"))

    def rows(self, df: DataFrame) -> DataFrame:
        return df.join(self.hot, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("file", "at"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")

    def once(self, df: DataFrame) -> DataFrame:
        """df, which has a digest once, with as many copies as its rows are dealt to."""
        return df.join(self.hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")

    def join(self, many: DataFrame, once: DataFrame) -> DataFrame:
        return self.rows(many).join(self.once(once), ["digest", "salt"]).drop("salt")


def _kept() -> Column:
    return (F.col("file") == F.col("best.file")) & (F.col("at") == F.col("best.at"))


def decided(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 1000) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    return _decided(*located(docs, scratch), scratch, id_col, text_col, digest, files_per_batch).drop("file", "at")


def _decided(docs, file, at, scratch, id_col, text_col, digest=sha256, files_per_batch=1000):
    told, narrow = _digested(docs, file, at, id_col, text_col, digest)
    seen = Observation()
    digests = scratch.table(narrow.observe(seen, F.count(F.lit(1)).alias("n")), "digests")
    groups = scratch.table(streamed_groups(docs.sparkSession, narrow.schema, scratch.base, files_per_batch), "groups")
    scratch.drop("changed", "state")
    dealt = _Dealt(groups, seen.get.get("n") or 0, scratch)

    # Bytes of every hit against those of the row that stays
    hit = groups.where("group_size > 1")
    staying = told.join(hit.select("digest", F.col("best.file").alias("file"), F.col("best.at").alias("at")), ["file", "at"]).select("digest", F.col("norm").alias("staying"))
    staying = scratch.table(staying, "staying")
    differ = dealt.join(told.select(digest(F.col("norm")).alias("digest"), "norm", "file", "at"), staying).where("norm != staying").select("digest")
    wrong = scratch.table(differ.distinct(), "wrong")
    scratch.drop("staying")
    right, chosen = dealt.join(digests, groups), ("id", "sha", "file", "at", F.col("best.id").alias("keep_id"), "group_size", _kept().alias("kept"))
    out = right.select(*chosen)
    if not wrong.isEmpty():
        again = told.join(wrong, digest(F.col("norm")) == F.col("digest"), "left_semi").select("norm", (-F.col("long")).alias("short"), F.col("id").isNull().alias("no_id"), "id", "file", "at")
        by_text = again.groupBy("norm").agg(F.count("*").alias("group_size"), F.min(F.struct(*_BEST)).alias("best"))
        again = again.join(by_text, "norm").withColumn("sha", sha256(F.col("norm"))).select(*chosen)
        out = right.join(wrong, "digest", "left_anti").select(*chosen).union(again)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), "file", "at")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    scratch = Scratch(docs.sparkSession, "exact")
    docs, file, at = located(docs, scratch)
    gone = _decided(docs, file, at, scratch, id_col, text_col).where("NOT kept").select(F.col("file").alias(file), F.col("at").alias(at))
    return docs.join(gone, [file, at], "left_anti").drop(file, at)


class Deduplicator:
    """Deliveries over time, judged against all there were: `folder`, shared by driver and executors, keeps the state, the digests and the
    texts of rows that stayed, and never forgets."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id", text_col: str = "text", files_per_batch: int = 1000):
        self.spark, self.base, self.id_col, self.text_col, self.files = spark, folder.rstrip("/"), id_col, text_col, files_per_batch

    def _written(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{path}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def deliver(self, docs: DataFrame, name: str) -> DataFrame:
        """Per row of the delivery: id, keep_id, group_size (all deliveries), kept. A later row with more code points takes the place of an
        earlier one. A name delivered again after a failure resumes, and counts once."""
        scratch = Scratch(self.spark, "delivery")
        docs, file, at = located(docs, scratch)
        docs = docs.withColumn(file, F.xxhash64(F.col(file), F.lit(name)))
        told, narrow = _digested(docs, file, at, self.id_col, self.text_col, sha256)
        if not self._written(f"digests/{name}"):
            narrow.write.mode("overwrite").parquet(f"{self.base}/digests/{name}")
        digests = self.spark.read.schema(narrow.schema).parquet(f"{self.base}/digests/{name}")
        groups = scratch.table(streamed_groups(self.spark, narrow.schema, self.base, self.files).join(digests.select("digest").distinct(), "digest", "left_semi"), "groups")
        dealt = _Dealt(groups, digests.count(), scratch)
        texts = told.select(sha256(F.col("norm")).alias("digest"), "norm", "file", "at")
        if not self._written(f"texts/{name}"):
            known, first = self._texts(name), digests.groupBy("digest").agg(F.min(F.struct("file", "at")).alias("f"))
            if known is not None:
                first = first.join(known.select("digest"), "digest", "left_anti")
            one = texts.join(first.select("f.file", "f.at"), ["file", "at"])
            one.select("digest", F.col("norm").alias("staying")).write.mode("overwrite").parquet(f"{self.base}/texts/{name}")
        if not dealt.join(texts, self._texts()).where("norm != staying").isEmpty():
            raise ValueError("texts with one digest differ")
        return dealt.join(digests, groups).select(F.col("id").alias(self.id_col), F.col("best.id").alias("keep_id"), "group_size", _kept().alias("kept"))

    def _texts(self, but: str = "") -> DataFrame | None:
        try:
            found = self.spark.read.schema("digest binary, staying string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{self.base}/texts")
        except AnalysisException:
            return None
        return found.where(~F.col("_metadata.file_path").contains(f"/texts/{but}/")) if but else found
