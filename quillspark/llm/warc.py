"""WARC as a PySpark Python data source, written and read.

Archives hold one gzip member per record, whose extra field ``sl`` gives the member's compressed and
uncompressed length, so a reader passes over records without inflating them. The reader plans
partitions of whole files, for all cores or of about ``PARTITION_BYTES`` together, takes predicates on headers (equality,
membership and null tests on record_type, page_id, uri, record_id, payload_digest), inflates a record as
far as its headers first, and inflates payloads only where the record passes and payloads are asked for
(option ``payload``, default true). Archives without the field, or uncompressed, are read too, by
running through them.

Writing goes through the commit protocol of data sources: a task writes files of its own name, and each
commit adds a list of those that count; readers take all lists together. An overwriting commit takes the
place of all lists before it, and deletes their files. Files roll at ``FILE_BYTES``. Paths are URIs of any
file system that pyarrow opens. In Spark 4.1 all uses of one such DataFrame within a plan share its reader, and
with it the predicates of the last: call ``read`` once for each way of filtering.

Defined cases: null html is an empty payload; a null url becomes ``urn:page:`` and the id; control
characters in a url are percent-encoded; a null page_id is written as empty and read as null; of equal
payloads of ``REVISIT_BYTES`` or more, rows with the smallest page_id (null last) are responses, all
others revisits; an empty table gives an empty archive; a payload of any length is one record, held in memory
as a row is. Extra columns are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

REVISIT_BYTES = 100
FILE_BYTES, PARTITION_BYTES, LEAST_BYTES = 64 << 20, 128 << 20, 1 << 20
BROADCAST_ROWS = 500_000
SCHEMA = "page_id long, record_type string, uri string, record_id string, payload_digest string, payload_length long, refers_to long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_HEADER_CHUNK = 1 << 12
MANIFEST = "_manifest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def record(row: dict) -> bytes:
    """One record, uncompressed; ``row``: page_id, url, payload, payload_digest, record_type, refers_to."""
    page = row["page_id"]
    raw = row["url"] if row["url"] is not None else f"urn:page:{'' if page is None else page}"
    uri = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in raw)
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {record_id(page, uri)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    if len(body) >= 1 << 32 or len(data) >= 1 << 32:
        raise ValueError("a record of 4 GB or more")
    extra = b"sl" + struct.pack("<HII", 8, len(body), len(data))
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def headers(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(file, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block or None) of the records whose headers are ``wanted``, of a seekable archive."""
    size, at = file.size(), 0
    while at < size:
        file.seek(at)
        start = file.read(min(_HEADER_CHUNK, size - at))
        if start[:2] == b"\x1f\x8b":
            extra = struct.unpack("<H", start[10:12])[0] if start[3] & 4 else 0
            known = bool(start[3] == 4 and extra == 12 and start[12:14] == b"sl")
            inflate = zlib.decompressobj(-15 if known else 31)
            length = struct.unpack("<I", start[16:20])[0] if known else None
            first = 12 + extra if known else 0
            buffer, tail, read = bytearray(), start[first : first + length if known else None], at + len(start)
            end = at + first + length if known else None

            def more(limit: int) -> bool:
                nonlocal tail, read
                if inflate.eof:
                    return False
                if not tail:
                    file.seek(read)
                    tail = file.read(min(1 << 16, (end if known else size) - read))
                    read += len(tail)
                    if not tail:
                        return False
                buffer.extend(inflate.decompress(tail, limit))
                tail = inflate.unconsumed_tail
                return True

            while (cut := buffer.find(b"\r\n\r\n")) < 0 and more(_HEADER_CHUNK):
                pass
            if cut < 0:
                raise ValueError(f"no end of headers at byte {at}")
            head = headers(bytes(buffer[:cut]))
            ok, block = wanted(head), None
            if ok and payloads or not known:
                while more(1 << 20):
                    pass
                block = bytes(buffer[cut + 4 : cut + 4 + int(head.get("content-length", 0))])
            at = end + 8 if known else read - len(inflate.unused_data)
        else:
            while (cut := start.find(b"\r\n\r\n")) < 0 and at + len(start) < size:
                start += file.read(_HEADER_CHUNK)
            if cut < 0:
                raise ValueError(f"no end of headers at byte {at}")
            head = headers(start[:cut])
            ok, block, length = wanted(head), None, int(head.get("content-length", 0))
            if ok and payloads:
                file.seek(at + cut + 4)
                block = file.read(length)
            at += cut + 4 + length + 4
        if ok:
            yield head, block if payloads else None


@dataclass
class Files(InputPartition):
    paths: list[str]


def _long(x: str | None) -> int | None:
    return int(x) if x else None


_VALUES = {
    "record_type": lambda h: h.get("warc-type"), "uri": lambda h: h.get("warc-target-uri"), "record_id": lambda h: h.get("warc-record-id"),
    "payload_digest": lambda h: (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "page_id": lambda h: _long(h.get("x-page-id")),
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() == "true"
        self.tasks = int(options.get("tasks", "1"))
        self.tests: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _VALUES and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, (f.value,)))
            elif column in _VALUES and isinstance(f, In) and None not in f.value:
                self.tests.append((column, tuple(f.value)))
            elif column in _VALUES and isinstance(f, IsNotNull):
                self.tests.append((column, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = _open(self.path)
        if lists := _manifests(system, root):
            infos = system.get_file_info([f"{root}/{n}" for n in _listed(system, lists)])
        else:
            infos = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.path.endswith((".warc", ".warc.gz"))]
        out: list[Files] = []
        room, most = 0, min(PARTITION_BYTES, max(LEAST_BYTES, sum(i.size for i in infos) // self.tasks))
        for info in sorted(infos, key=lambda i: i.path):
            if not out or room + info.size > most:
                out.append(Files([]))
                room = 0
            out[-1].paths.append(info.path)
            room += info.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        system, _ = _open(self.path)
        wanted = lambda h: all((v := _VALUES[c](h)) is not None and (values is None or v in values) for c, values in self.tests)
        rows: list[tuple] = []
        size = 0
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for head, block in records(file, wanted, self.payloads):
                    payload = None
                    if block is not None and head.get("warc-type") == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((*(_VALUES[c](head) for c in ("page_id", "record_type", "uri", "record_id", "payload_digest")), _long(head.get("x-payload-length")), _long(head.get("x-refers-to-page-id")), payload))
                    size += len(payload or b"") + 200
                    if size > 8 << 20:
                        yield flush()
                        rows, size = [], 0
        if rows:
            yield flush()


def _manifests(system: fs.FileSystem, root: str) -> list[str]:
    """The lists of all commits to a folder."""
    return [i.path for i in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith(MANIFEST)]


def _listed(system: fs.FileSystem, lists: list[str]) -> list[str]:
    names: list[str] = []
    for path in lists:
        with system.open_input_stream(path) as f:
            names += json.loads(f.read())
    return names


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or out.tell() >= FILE_BYTES:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out = system.open_output_stream(f"{root}/{names[-1]}", compression=None)
                out.write(member(record(row)))
        if out:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        before = _manifests(system, root) if self.overwrite else []
        gone = _listed(system, before)
        with system.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for path in [*before, *(f"{root}/{n}" for n in gone)]:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to. The payloads are shuffled only if more than ``BROADCAST_ROWS`` of them repeat."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    same = rows.filter(F.octet_length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("payload_digest", "first")
    few = same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(same) if few else same, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Adds records of ``pages`` to the archives in ``path``, or, with mode overwrite, puts them in their place."""
    register(pages.sparkSession)
    plan(pages).write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tasks", 4 * spark.sparkContext.defaultParallelism).load(path)


def sums(archive: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: of responses from their payloads, of revisits from their headers."""
    whole = F.col("record_type") == "response"
    return archive.select("page_id", F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"), F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
