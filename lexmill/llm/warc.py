"""WARC archives: a writer that marks repeated payloads as revisits, and a sequential reader.

Every record is one gzip member. The reader takes a file in blocks, decompresses incrementally, frames records by
Content-Length (which may span blocks and members) and verifies block and payload digests; its memory is bounded by
the largest record. Files lie in a folder that driver and executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.scratch import fresh_path, written

#: a file is closed after the record that takes it to this size
ROLL_BYTES, READ_BLOCK = 64 << 20, 1 << 16
#: bytes of archives that a reading task takes, on average
READ_BYTES = 128 << 20
#: revisits whose table may be broadcast
BROADCAST_REVISITS = 200_000
DATE = "2000-01-01T00:00:00Z"
ID = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, mark: str | int | None = None, target_mark: int | None = None) -> bytes:
    """One record, compressed. A revisit's block is the response's HTTP head alone, which tells the payload's length.

    Marks follow ids that several records have, so that a record's name is its own."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda i, own: f"<{ID}{'null' if i is None else i}{'' if own is None else f':{own}'}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id, mark)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))] if url else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Refers-To", name(refers_to, target_mark)), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def inflate(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of a chain of gzip members, as they come."""
    z, begun = zlib.decompressobj(31), False
    for data in blocks:
        while data:
            begun = True
            if out := z.decompress(data, 1 << 20):
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the file ends within a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record."""
    held, plain = bytearray(), inflate(blocks)

    def more() -> bool:
        part = next(plain, b"")
        held.extend(part)
        return bool(part)

    while held or more():
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                raise ValueError("the file ends within a record's head")
        version, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, at = int(fields["content-length"]), end + 4
        while len(held) < at + size + 4:
            if not more():
                raise ValueError("the file ends within a record's block")
        if held[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("a record's block has another length than it says")
        yield fields, bytes(held[at : at + size])
        del held[: at + size + 4]


def page_of(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").removeprefix(ID).partition(":")[0]
    return None if name in ("", "null") else int(name)


def verified(fields: dict[str, str], block: bytes) -> dict:
    """A record's row; a digest that doesn't fit its bytes raises ValueError."""
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest of {fields['warc-record-id']}")
    head, _, payload = block.partition(b"\r\n\r\n")
    said = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(x.split(b":")[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    kind = fields["warc-type"]
    if kind == "response" and (said != digest(payload) or size != len(payload)):
        raise ValueError(f"payload digest of {fields['warc-record-id']}")
    return {"page_id": page_of(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(path, n_records, n_bytes): the archives' files. One record per row; null html is an empty payload.

    Of rows with equal payloads of at least min_bytes bytes, those with the smallest id are the response, and others
    revisit it; rows with null ids are always responses. Rows that share an id get names of their own, and a revisit names
    one of the responses; such rows alone are written down beforehand, to be numbered.
    Each attempt of a task writes files of its own, and only those of the attempt that ended well are listed. Pages
    keep their partitions if the revisits are few enough to be broadcast; else they are joined by a shuffle."""
    spark = pages.sparkSession
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sums = src.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sum"), F.octet_length("html").alias("size"))
    sums = written(sums, "digests")
    several = written(sums.filter("page_id is not null").groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id"), "several")
    sums = sums.filter(F.col("size") >= min_bytes)
    firsts = sums.groupBy("sum", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").hint("rebalance")
    again = written(sums.join(firsts, ["sum", "size"]).filter("page_id <> first").select("page_id", F.col("sum").alias("own"), "first").distinct(), "revisits")
    few = again.count() <= BROADCAST_REVISITS
    none = F.lit(None).cast("long")
    if repeated := several.count():
        ids = F.broadcast(several) if repeated <= BROADCAST_REVISITS else several
        copies = written(src.join(ids, "page_id", "left_semi").withColumn("mark", F.monotonically_increasing_id()), "copies")
        heads = copies.groupBy(F.col("page_id").alias("first"), F.sha1(F.col("html").cast("binary")).alias("own")).agg(F.min("mark").alias("target_mark"))
        again = again.join(heads, ["first", "own"], "left")
        src = src.join(ids, "page_id", "left_anti").withColumn("mark", none).unionByName(copies)
    else:
        src, again = src.withColumn("mark", none), again.withColumn("target_mark", none)
    keyed = src.withColumn("own", F.sha1(F.col("html").cast("binary")))
    marked = keyed.join(F.broadcast(again) if few else again, ["page_id", "own"], "left").select("page_id", "url", "html", "first", "mark", "target_mark")
    folder = fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        files: list[tuple[str, int, int]] = []
        out, path, name, n, size = None, "", "", 0, 0
        for batch in batches:
            for page_id, url, html, first, mark, target in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = uuid.uuid4().hex, 0, 0
                    path = f"{top}/part-{name}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), first, first is not None, f"{name}-{n}" if page_id is None else mark, target)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    files.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            files.append((path, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rpartition('/')[2]}" for p, _, _ in files], pa.string()), pa.array([x[1] for x in files], pa.int64()), pa.array([x[2] for x in files], pa.int64())], names=["path", "n_records", "n_bytes"])

    return written(marked.mapInArrow(run, "path string, n_records long, n_bytes long"), "archives")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the files in ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url[, payload].

    Files are dealt out evenly to tasks of READ_BYTES on average, or one by one where ``n_bytes`` doesn't tell their sizes; a
    broken file fails the job."""
    kinds = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "url": "string"} | ({"payload": "binary"} if with_payload else {})
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(path, compression=None) as f:
                    rows: list[dict] = []
                    held = 0
                    for fields, block in records(iter(lambda: f.read(READ_BLOCK), b"")):
                        rows.append(verified(fields, block))
                        held += len(block)
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow[t]) for k, t in kinds.items()], names=list(kinds))
                            rows, held = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], arrow[t]) for k, t in kinds.items()], names=list(kinds))

    sizes = F.sum("n_bytes") if "n_bytes" in files.columns else F.lit(None)
    n, total = files.agg(F.count("*"), sizes).first()
    few = n if total is None else max(-(-total // READ_BYTES), files.sparkSession.sparkContext.defaultParallelism)
    spread = files.select("path").repartition(max(1, min(n, few)))
    return spread.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(files, with_payload=False).drop("url")


def oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    chars = " || ".join(f"substr('{alphabet}', 1 + ((('0x' || substr(sum, {5 * g + 1}, 5))::bigint >> {5 * (3 - k)}) & 31)::int, 1)" for g in range(8) for k in range(4))
    return f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sum from pages),
q as (select page_id, strlen(html)::bigint as payload_bytes, sum, min(page_id) over (partition by sum) as first from p)
select page_id, payload_bytes, {chars} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id = first then null else first end::bigint as refers_to from q"""
