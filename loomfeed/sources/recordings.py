"""Recorded fetches as a data source: folders of web archive files that Spark reads and writes.

`spark.read.format("recorded_fetches").load(folder)` gives one row for every response;
`df.write.format("recorded_fetches").mode("append").save(folder)` records rows. A file is a
row of gzip members, one response each, as web archives (WARC 1.0) have them, so other
tools read them too. Files lie in one folder a shard of hosts; a filter for a host opens
the files of its shard only. Folders must be readable by all executors: shared disks, or
what pyarrow's file systems reach.
"""

from __future__ import annotations

import gzip
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "host string, url string, fetched_at string, status int, content_type string, body binary"
SHARDS = 64
#: Bytes of bodies after which a task begins another file.
FILE_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_TYPES = pa.schema([("host", pa.string()), ("url", pa.string()), ("fetched_at", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary())])


def host_of(url: str | None) -> str | None:
    """The host in lower case; null where a URL has none."""
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


def shard_of(host: str | None) -> str:
    return f"shard={zlib.crc32((host or '').encode()) % SHARDS:03d}"


def _one_line(s) -> str:
    return " ".join(str(s).split()) if s is not None else ""


def to_record(url, fetched_at, status, content_type, body) -> bytes:
    """One response as a gzip member. Null fields are left out; line breaks in them become spaces."""
    http = [f"HTTP/1.1 {status if status is not None else '-'}"] + ([f"Content-Type: {_one_line(content_type)}"] if content_type is not None else [])
    block = ("\r\n".join(http) + "\r\n\r\n").encode() + (body or b"")
    head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"WARC-Date: {_one_line(fetched_at)}"] if fetched_at is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress(("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n", 5, mtime=0)


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def records(stream) -> Iterator[tuple]:
    """(host, url, fetched_at, status, content_type, body) of the responses in an opened archive, one at a time; a broken end of file raises."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a web archive")
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        head = _headers(head)
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise EOFError("the last record is cut off")
        if head.get("warc-type") != "response":
            continue
        first, _, body = block.partition(b"\r\n\r\n")
        status, *lines = first.split(b"\r\n")
        parts, http = status.split(b" "), _headers(lines)
        url = head.get("warc-target-uri")
        yield host_of(url), url, head.get("warc-date"), int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None, http.get("content-type"), body


@dataclass
class _File(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.shards = path, None

    def pushFilters(self, filters: list[Filter]):
        """Hosts choose shards; every filter stays with Spark, as a shard holds other hosts too."""
        for f in filters:
            hosts = [f.value] if isinstance(f, EqualTo) and f.attribute == ("host",) else f.value if isinstance(f, In) and f.attribute == ("host",) else None
            if hosts is not None:
                mine = {shard_of(h) for h in hosts}
                self.shards = mine if self.shards is None else self.shards & mine
            yield f

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        names = sorted(f.path for f in found if f.is_file and f.path.endswith(".warc.gz"))
        return [_File(n) for n in names if self.shards is None or n.split("/")[-2] in self.shards] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_stream(partition.path, compression=None) as raw, gzip.open(raw) as stream:
            rows, size = [], 0
            for r in records(stream):
                rows.append(r)
                size += len(r[-1]) + 200
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TYPES, strict=True)], schema=_TYPES)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Tasks write files under hidden names; the commit gives them their names, so a lost task leaves nothing that is read."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        files, opened = [], {}
        for b in iterator:
            for r in b.select(["url", "fetched_at", "status", "content_type", "body"]).to_pylist():
                shard = shard_of(host_of(r["url"]))
                if shard not in opened:
                    name = uuid.uuid4().hex
                    fs.create_dir(f"{root}/{shard}", recursive=True)
                    files.append((f"{root}/{shard}/_{name}", f"{root}/{shard}/{name}.warc.gz"))
                    opened[shard] = [fs.open_output_stream(files[-1][0], compression=None), 0]
                data = to_record(r["url"], r["fetched_at"], r["status"], r["content_type"], r["body"])
                opened[shard][0].write(data)
                opened[shard][1] += len(data)
                if opened[shard][1] >= FILE_BYTES:
                    opened.pop(shard)[0].close()
        for stream, _ in opened.values():
            stream.close()
        return _Written(files)

    def commit(self, messages) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file and f.path.endswith(".warc.gz")] if self.overwrite else []
        for m in messages:
            for hidden, name in m.files if m else ():
                fs.move(hidden, name)
        for path in old:
            fs.delete_file(path)

    def abort(self, messages) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for hidden, _name in m.files if m else ():
                fs.delete_file(hidden)


class RecordedFetches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_fetches"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        return path if "://" in path or path.startswith("file:") else f"file://{path}"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._uri())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._uri(), overwrite)

    def _uri(self) -> str:
        path = self._path()
        return "file://" + path.removeprefix("file:") if path.startswith("file:") and not path.startswith("file://") else path


def register(spark: SparkSession) -> None:
    """Make the data source known to a session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedFetches)
