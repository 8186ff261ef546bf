"""Streams with keyed state: chunk diffs of document versions, and edges that wait for their targets.

What a batch costs follows from its own keys or their pages; state lies in the store and is never written as a whole. The same
rows again change nothing, so batches can be replayed, and what is given out in the end doesn't depend on the order of
arrival.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexmill.streaming.feed import change_feed

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: parts of a citation's waiting edges, so that one that very many edges cite isn't one task's
SALTS = 8
#: pages that citations are dealt out to
PAGES = 1024


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in the store that keyed state needs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Diffs(StatefulProcessor):
    """A document's last version and chunks; each later version gives out what differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "version long")
        self.chunks = handle.getMapState("chunks", "id string", "content_hash string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = sorted((int(v), dict(zip(ids, hashes))) for df in rows for v, ids, hashes in zip(df["version"], df["ids"], df["hashes"]))
        last = self.version.get()[0] if self.version.exists() else None
        new = [(v, c) for v, c in new if last is None or v > last]
        if not new:
            return
        start = {k[0]: v[0] for k, v in self.chunks.iterator()} if last is not None else {}
        held, out = dict(start), []
        for version, chunks in new:
            if version == last:
                continue
            out += [(key[0], version, c, "upsert", h) for c, h in chunks.items() if held.get(c) != h]
            out += [(key[0], version, c, "delete", None) for c in held if c not in chunks]
            held, last = chunks, version
        for c in start.keys() - held.keys():
            self.chunks.removeKey((c,))
        for c, h in held.items():
            if start.get(c) != h:
                self.chunks.updateValue((c,), (h,))
        self.version.update((last,))
        yield pd.DataFrame(out, columns=["document_id", "version", "id", "action", "content_hash"])

    def close(self) -> None:
        pass


def chunk_diffs(versions: DataFrame) -> DataFrame:
    """(document_id, version, id, action, content_hash) from a stream (document_id string, version long, ids array<string>, hashes array<string>).

    A version is a document's whole set of chunks at that time. New and changed chunks are upserts, vanished ones deletes;
    a version that isn't later than the last one seen gives nothing, so neither replays nor stragglers undo anything.
    Rows without a document or version are left out; a null set of chunks is an empty one."""
    empty = F.array().cast("array<string>")
    rows = versions.filter("document_id is not null and version is not null").select("document_id", "version", F.coalesce("ids", empty).alias("ids"), F.coalesce("hashes", empty).alias("hashes"))
    made = "document_id string, version long, id string, action string, content_hash string"
    return rows.groupBy("document_id").transformWithStateInPandas(_Diffs(), made, "Append", "None")


_EDGE = ["citation", "edge_id", "own", "inbound", "reference_type", "change_type"]


class _Waiting(StatefulProcessor):
    """A page of citations: their documents once they are known, and the edges that wait for them until then.

    A key, and a value of state, costs far more than a row: keys are pages, and a value is what one batch adds to a page,
    a list for each column."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "citation array<string>, document_id array<string>")
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} array<{'boolean' if c == 'inbound' else 'string'}>" for c in _EDGE))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came, edges = [], []
        for df in rows:
            doc = df["document_id"].notna()
            came.append(df.loc[doc, ["citation", "document_id"]])
            edges.append(df.loc[~doc, _EDGE])
        targets = {c: d for citations, ids in self.known.get() for c, d in zip(citations, ids)}
        least = pd.concat(came).groupby("citation")["document_id"].min()
        new = {c: d for c, d in least.items() if c not in targets}
        targets |= new
        if new:
            self.known.appendValue((list(new), list(new.values())))
            old = pd.DataFrame([edge for columns in self.waiting.get() for edge in zip(*columns)], columns=_EDGE)
            due = old["citation"].isin(list(new))
            if due.any():
                edges.insert(0, old[due])
                self.waiting.clear()
                self._wait(old[~due])
        all_edges = pd.concat(edges).drop_duplicates(["citation", "edge_id"], keep="last")
        target = all_edges["citation"].map(targets)
        there = target.notna()
        self._wait(all_edges[~there])
        if there.any():
            e, target = all_edges[there], target[there]
            inbound = e["inbound"].astype(bool)
            ends = {"source_document_id": target.where(inbound, e["own"]), "target_document_id": e["own"].where(inbound, target)}
            yield pd.DataFrame({"id": e["edge_id"], **ends, "reference_type": e["reference_type"], "change_type": e["change_type"]})

    def _wait(self, edges: pd.DataFrame) -> None:
        if len(edges):
            plain = edges.assign(inbound=edges["inbound"].astype(bool)).astype(object)
            self.waiting.appendValue(tuple(plain[c].where(plain[c].notna(), None).tolist() for c in _EDGE))

    def close(self) -> None:
        pass


BOUND = "id string, source_document_id string, target_document_id string, reference_type string, change_type string"


def bound_edges(arrivals: DataFrame, salts: int = SALTS, pages: int = PAGES) -> DataFrame:
    """(id, source_document_id, target_document_id, reference_type, change_type) of edges, as soon as the document that they cite is there.

    arrivals: a stream of both documents (citation, document_id) and edges (citation, edge_id, own, inbound,
    reference_type, change_type), the others' columns null; own is the document whose text or card names the citation.
    Edges wait in the state of the citation's page, outbound and inbound ones alike: an inbound one, whose source is the
    cited document, never comes out if that stays unknown. Each edge comes out once, unless it arrives again later; then it
    comes with the same values. If several documents of one batch have a citation, the least id counts, and no later one.

    Citations are dealt out to ``pages``; a batch reads the documents of those pages that its citations are on, and their
    waiting edges if it brings a new document. A citation's edges wait in ``salts`` parts, to each of which its document
    goes. Both numbers stay as they are for as long as the state is kept."""
    parts = F.when(F.col("document_id").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.pmod(F.xxhash64("edge_id"), F.lit(salts)).cast("int")))
    rows = arrivals.filter("citation is not null and (document_id is not null or edge_id is not null)").withColumn("part", F.explode(parts))
    rows = rows.withColumn("page", F.pmod(F.xxhash64("citation"), F.lit(pages)).cast("int")).select("page", "part", "document_id", *_EDGE)
    return rows.groupBy("page", "part").transformWithStateInPandas(_Waiting(), BOUND, "Append", "None")


def run_into(stream: DataFrame, folder: str) -> DataFrame:
    """Takes what there is in the stream and ends. What it gives out is kept by batch, so a batch that is run again
    overwrites its own rows alone; returns all rows so far. Progress and state are kept beside them."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with keyed_state(spark):
        stream.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows")


def index_state(diffs: DataFrame) -> DataFrame:
    """(document_id, id, content_hash): the chunks that are there after all diffs; applying some of them twice changes nothing."""
    last = diffs.groupBy("document_id", "id").agg(F.max_by(F.struct("action", "content_hash"), "version").alias("r"))
    return last.filter("r.action = 'upsert'").select("document_id", "id", "r.content_hash")


def stream_of(spark: SparkSession, path: str, *columns: Column, files_per_batch: int = 16) -> DataFrame:
    """Columns of a log of Parquet files, read as a stream."""
    return change_feed(spark, path, files_per_batch).select(*columns)
