"""The change feed: an append log, independent projectors, chunk diffs and reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.upsert import latest
from lexmill.scratch import fresh_path

NOT_APPLICABLE, FAILED = "not_applicable", "failed"


def change_feed(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """An append log of Parquet files, in a folder or a single one, as a stream. The schema is that of the files there."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rstrip("/").rpartition("/")
        return stream.option("pathGlobFilter", name).parquet(folder)
    return stream.parquet(path)


class Projector:
    """A target's state, kept as one snapshot per batch in a folder of its own.

    A batch's snapshot is made from the last one and written under the batch's number, so a batch that is run again
    overwrites its own result and nothing else. ``fold`` takes (state or None, batch) and returns the new state."""

    def __init__(self, spark: SparkSession, folder: str, fold: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
        self.spark, self.folder, self.fold = spark, folder, fold

    def _path(self, batch: int) -> str:
        return f"{self.folder}/state/batch={batch}"

    def _batches(self) -> list[int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        store = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [s.getPath() for s in store.listStatus(p)] if store.exists(p) else []
        return sorted(int(x.getName().removeprefix("batch=")) for x in done if store.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def state(self, before: int | None = None) -> DataFrame | None:
        there = [b for b in self._batches() if before is None or b < before]
        return self.spark.read.parquet(self._path(there[-1])) if there else None

    def apply(self, batch: DataFrame, number: int) -> None:
        self.fold(self.state(number), batch).write.mode("overwrite").parquet(self._path(number))

    def run(self, feed: DataFrame) -> None:
        """Takes what there is in the feed and ends; the stream's progress is kept in the folder."""
        q = feed.writeStream.foreachBatch(lambda df, n: self.apply(df, n)).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        q.awaitTermination()


def latest_fold(key: list[str], order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Keeps each key's last row; a batch or row that comes twice changes nothing."""

    def fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = batch if state is None else state.unionByName(batch)
        return latest(rows, key, [F.desc(c) for c in order])

    return fold


def project_log(spark: SparkSession, path: str, key: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of a log, by way of the stream."""
    projector = Projector(spark, fresh_path(spark, "projector"), latest_fold(key, order))
    projector.run(change_feed(spark, path))
    state = projector.state()
    return state if state is not None else spark.read.parquet(path).limit(0)


def reconcile(document: DataFrame, state: DataFrame, targets: list[str]) -> DataFrame:
    """(document_id, target, reason) of what has to be projected again: missing, failed or stale. Versions are hashes and are compared for equality alone."""
    want = document.select(F.col("id").alias("document_id"), "content_version").withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    seen = state.select("document_id", "target", "synced_version", "status")
    rows = want.join(seen, ["document_id", "target"], "left")
    reason = F.when(F.col("status") == NOT_APPLICABLE, None).when(F.col("status").isNull(), "missing").when(F.col("status") == FAILED, "failed").when(~F.col("synced_version").eqNullSafe(F.col("content_version")), "stale")
    return rows.withColumn("reason", reason).filter("reason is not null")


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, action, content_hash): upsert of new and changed chunks, delete of vanished ones; equal ones are left out."""
    a, b = old.select(F.col("id").alias("i"), F.col("content_hash").alias("was")), new.select("id", "content_hash")
    both = b.join(a, F.col("id") == F.col("i"), "full_outer")
    action = F.when(F.col("id").isNull(), "delete").when(~F.col("content_hash").eqNullSafe(F.col("was")), "upsert")
    return both.select(F.coalesce("id", "i").alias("id"), action.alias("action"), "content_hash").filter("action is not null")


def apply_diff(index: DataFrame, diff: DataFrame, chunks: DataFrame) -> DataFrame:
    """An index's next state; applied twice it changes nothing."""
    kept = index.join(diff.select("id"), "id", "left_anti")
    return kept.unionByName(chunks.join(diff.filter("action = 'upsert'").select("id"), "id", "left_semi").select(*index.columns))
