"""Stored responses of a fetcher as a data source: ``spark.read``, ``spark.readStream`` and ``df.write`` by one format.

A store is a folder, which driver and executors share, of numbered segments. A segment holds responses one after another:
a line with the percent-encoded address, the status line, headers, an empty line, and a body as long as ``Content-Length`` says. Segments
are only ever added, by one writer at a time, so a number is a stream's offset: a batch is the segments after the last
one taken, and reading it again gives the same rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

FORMAT = "stored_responses"
SCHEMA = "url string, status int, media string, body string, segment long, position long"
#: a segment is closed after the response that takes it to this size; a reading task takes segments up to this size in all
SEGMENT_BYTES, TASK_BYTES = 64 << 20, 128 << 20
#: rows and bytes of bodies that go to Spark at once
BATCH_ROWS, BATCH_BYTES, BLOCK = 1000, 8 << 20, 1 << 20
_NAME = re.compile(r"responses-(\d{12})\.http")
_KINDS = {"url": pa.string(), "status": pa.int32(), "media": pa.string(), "body": pa.string(), "segment": pa.int64(), "position": pa.int64()}


def stored(url: str | None, status: int | None, media: str | None, body: str | None) -> bytes:
    """One response as it is stored. Nulls have no field of their own, so they come back as nulls."""
    lines = ["" if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=~-._") or "%", "HTTP/1.1" if status is None else f"HTTP/1.1 {status}"]
    if media is not None:
        lines.append(f"Content-Type: {quote(media, safe='/;= ')}; charset=utf-8")
    data = b""
    if body is not None:
        data = body.encode("utf-8", "surrogatepass")
        lines.append(f"Content-Length: {len(data)}")
    return "\r\n".join([*lines, "", ""]).encode() + data + b"\r\n"


def decoded(headers: dict[str, str], data: bytes) -> tuple[str | None, str | None]:
    """(media type, text) of a body: gzip and deflate are undone, bytes that the charset hasn't are replaced."""
    kind = headers.get("content-type")
    media, _, rest = (kind or "").partition("; charset=")
    packing = headers.get("content-encoding", "").lower()
    if packing == "gzip":
        data = zlib.decompress(data, 47)
    elif packing == "deflate":
        data = zlib.decompress(data, 15 if data[:1] == b"\x78" else -15)
    try:
        text = data.decode(rest.strip('" ') or "utf-8", "surrogatepass" if not rest or rest.lower() == "utf-8" else "replace")
    except (LookupError, UnicodeDecodeError):
        text = data.decode("utf-8", "replace")
    return (None if kind is None else unquote(media)), (text if "content-length" in headers else None)


def responses(blocks: Iterator[bytes]) -> Iterator[tuple[str | None, int | None, str | None, str | None]]:
    """(url, status, media, body) of each response of a segment; a segment that ends within one raises ValueError."""
    held = bytearray()

    def need(size: int) -> None:
        while len(held) < size:
            part = next(blocks, b"")
            if not part:
                raise ValueError("the segment ends within a response")
            held.extend(part)

    while True:
        if not held:
            held.extend(next(blocks, b""))
            if not held:
                return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            need(seen + 1)
        url, status, *lines = held[:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers.get("content-length", 0))
        need(end + 4 + size + 2)
        if held[end + 4 + size : end + 6 + size] != b"\r\n":
            raise ValueError("a response has another length than it says")
        code = status.split(" ")[1:2]
        yield (None if url == "" else unquote(url) if url != "%" else ""), (int(code[0]) if code else None), *decoded(headers, bytes(held[end + 4 : end + 4 + size]))
        del held[: end + size + 6]


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def segments(path: str) -> list[tuple[int, str, int]]:
    """(number, path, bytes) of a store's segments, in order; a missing folder has none."""
    from pyarrow import fs

    store, top = _folder(path)
    found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
    named = ((_NAME.fullmatch(f.base_name), f) for f in found)
    return sorted((int(m[1]), f.path, f.size) for m, f in named if m)


@dataclass
class Portion(InputPartition):
    """Segments that one task reads, one after another."""

    segments: list[tuple[int, str]]


def portions(found: list[tuple[int, str, int]], most: int = TASK_BYTES) -> list[Portion]:
    out: list[Portion] = []
    room = 0
    for number, path, size in found:
        if not out or size > room:
            out.append(Portion([]))
            room = most
        out[-1].segments.append((number, path))
        room -= size
    return out or [Portion([])]


def read_portion(path: str, portion: Portion) -> Iterator[pa.RecordBatch]:
    store, _ = _folder(path)
    for number, name in portion.segments:
        with store.open_input_stream(name, compression=None) as f:
            rows: list[tuple] = []
            held = 0
            for at, row in enumerate(responses(iter(lambda: f.read(BLOCK), b""))):
                rows.append((*row, number, at))
                held += len(row[3] or "")
                if len(rows) >= BATCH_ROWS or held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS.values())], names=list(_KINDS))


class Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Portion]:
        return portions(segments(self.path))

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        return read_portion(self.path, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are numbers of segments: {"segment": the last one taken}."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:  # noqa: N802
        return {"segment": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"segment": max((n for n, _, _ in segments(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Portion]:
        return portions([s for s in segments(self.path) if start["segment"] < s[0] <= end["segment"]])

    def read(self, partition: Portion) -> Iterator[pa.RecordBatch]:
        return read_portion(self.path, partition)


@dataclass
class Staged(WriterCommitMessage):
    """Paths of the files that an attempt of a task wrote."""

    paths: list[str]


class Writer(DataSourceArrowWriter):
    """Tasks write files of their own beside the store; the commit numbers those of the attempts that ended well."""

    def __init__(self, path: str, names: list[str]) -> None:
        self.path, self.names, self.staging = path, names, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, top = _folder(self.path)
        folder, paths, out, size = f"{top}/{self.staging}", [], None, 0
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            empty = [None] * batch.num_rows
            columns = (batch.column(self.names.index(n)).to_pylist() if n in self.names else empty for n in ("url", "status", "media", "body"))
            for row in zip(*columns):
                if out is None:
                    paths.append(f"{folder}/{uuid.uuid4().hex}")
                    out, size = store.open_output_stream(paths[-1], compression=None), 0
                data = stored(*row)
                out.write(data)
                size += len(data)
                if size >= SEGMENT_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Staged(paths)

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = _folder(self.path)
        number = max((n for n, _, _ in segments(self.path)), default=-1)
        for path in (p for m in messages if m for p in m.paths):
            number += 1
            store.move(path, f"{top}/responses-{number:012d}.http")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, top = _folder(self.path)
        try:
            store.delete_dir(f"{top}/{self.staging}")
        except FileNotFoundError:  # no task began
            pass


class StoredResponses(DataSource):
    """Option ``path``: the store's folder. Writing takes url, status, media and body by name, those that are there, and only appends."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a store of responses needs a path")
        return path.rstrip("/")

    def reader(self, schema) -> Reader:
        return Reader(self._path())

    def streamReader(self, schema) -> StreamReader:  # noqa: N802
        return StreamReader(self._path())

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("a store of responses is only appended to")
        return Writer(self._path(), schema.names)


def register(spark: SparkSession) -> str:
    """Makes the format known to the session; returns its name."""
    spark.dataSource.register(StoredResponses)
    return FORMAT
