"""ZIP archives as a PySpark Python data source, read entry by entry and written.

Reading plans by size: small archives are read whole by one task, several together; of larger ones the central
directory alone is read first, and their entries are dealt to tasks. Files are read by range: the directory
at the end, then the entries that are wanted. Predicates on archive and path (equality, membership, prefix,
suffix, containment) are taken before anything is inflated, and with option ``content`` false nothing is.
A task holds one entry at a time besides some 8 MB of rows that wait to be passed on. In Spark 4.1 all uses
of one such DataFrame within a plan share its reader, and with it the predicates of the last: call ``read``
once for each way of filtering.

Defined cases: directories and resource forks (__MACOSX) aren't entries; entries that can't be read, for damage or a
password, and those longer than option ``most`` have null content and an error; archives that can't be
opened give no rows. Writing takes path and content, rolls archives at ``FILE_BYTES``, and archives
appear when the job commits.
"""

from __future__ import annotations

import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from quillspark.sources import documents, files

SCHEMA = "archive string, path string, size long, content binary, error string"
PARTITION_BYTES, FILE_BYTES, HELD_BYTES = 64 << 20, 64 << 20, 8 << 20
BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, ValueError, EOFError, OSError)
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
_TESTS: dict[type, Callable] = {
    EqualTo: lambda f: lambda v: v == f.value, In: lambda f: lambda v: v in f.value, StringStartsWith: lambda f: lambda v: v.startswith(f.value),
    StringEndsWith: lambda f: lambda v: v.endswith(f.value), StringContains: lambda f: lambda v: f.value in v,
}


@dataclass
class Entries(InputPartition):
    """Whole archives (names None), or some entries of one."""

    archives: list[str]
    names: list[str] | None = None


def _entries(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in archive.infolist() if not i.filename.startswith("__MACOSX") and not i.is_dir()]


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "true").lower() == "true"
        self.bytes, self.most = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("most", 1 << 31))
        self.tests: dict[str, list] = {"archive": [], "path": []}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in self.tests and type(f) in _TESTS and getattr(f, "value", None) is not None:
                self.tests[column].append(f)
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(_TESTS[type(f)](f)(value) for f in self.tests[column])

    def partitions(self) -> list[InputPartition]:
        system, root = files.opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((i for i in found if i.type == fs.FileType.File and i.path.lower().endswith(".zip") and self._wanted("archive", i.base_name)), key=lambda i: i.path)
        out, room = [], 0
        for i in found:
            if i.size > self.bytes:
                out += self._dealt(system, i.path)
            elif out and out[-1].names is None and room + i.size <= self.bytes:
                out[-1].archives.append(i.path)
                room += i.size
            else:
                out.append(Entries([i.path]))
                room = i.size
        return out or [Entries([])]

    def _dealt(self, system: fs.FileSystem, path: str) -> list[Entries]:
        """Tasks for the entries of a large archive, by its central directory, in order of place."""
        out, room = [], 0
        try:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                for i in sorted(_entries(z), key=lambda i: i.header_offset):
                    if self._wanted("path", i.filename):
                        if not out or room + i.compress_size > self.bytes:
                            out.append(Entries([path], []))
                            room = 0
                        out[-1].names.append(i.filename)
                        room += i.compress_size
        except BROKEN:
            return []
        return out

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        system, _ = files.opened(self.path)
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], [c.split()[0] for c in SCHEMA.split(", ")])
        for path in partition.archives:
            for row in self._rows(system, path, partition.names):
                rows.append(row)
                held += len(row[3] or b"") + 200
                if held > HELD_BYTES:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    def _rows(self, system: fs.FileSystem, path: str, names: list[str] | None) -> Iterator[tuple]:
        own = path.rsplit("/", 1)[-1]
        try:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                wanted = [i for i in _entries(z) if self._wanted("path", i.filename) and (names is None or i.filename in names)]
                for i in sorted(wanted, key=lambda i: i.header_offset):
                    content = error = None
                    if self.content and i.file_size > self.most:
                        error = "too large"
                    elif self.content:
                        try:
                            content = z.read(i)
                        except BROKEN as e:
                            error = f"{type(e).__name__}: {e}"
                    yield own, i.filename, i.file_size, content, error
        except BROKEN:
            return


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ZipWriter(DataSourceArrowWriter):
    """Archives are written beside their final names; the commit of the job renames those that count."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = files.opened(self.path)
        system.create_dir(root, recursive=True)
        names: list[str] = []
        out = z = None
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if z is None or out.tell() >= FILE_BYTES:
                    if z is not None:
                        z.close()
                        out.close()
                    names.append(uuid.uuid4().hex)
                    out = system.open_output_stream(f"{root}/{names[-1]}.part", compression=None)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(zipfile.ZipInfo(path), content or b"", zipfile.ZIP_DEFLATED)
        if z is not None:
            z.close()
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = files.opened(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.move(f"{root}/{name}.part", f"{root}/{name}.zip")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = files.opened(self.path)
        for name in [n for m in messages if m for n in m.names]:
            system.delete_file(f"{root}/{name}.part")


class ZipDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        if overwrite:
            raise ValueError("archives can only be added")
        return ZipWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZipDataSource)


def read(spark: SparkSession, path: str, content: bool = True, **options) -> DataFrame:
    """archive, path, size, content, error of the entries of all archives below ``path``."""
    register(spark)
    return spark.read.format("zipped").options(content=str(content).lower(), **{k: str(v) for k, v in options.items()}).load(path)


def write(entries: DataFrame, path: str) -> None:
    """Adds archives with the ``entries`` (path, content) to ``path``."""
    register(entries.sparkSession)
    entries.select("path", "content").write.format("zipped").mode("append").save(path)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """As ``documents.expand_zip``, of the archives below ``path``, none of which is ever in memory as a whole."""
    rows = read(spark, path, most=documents.MAX_BYTES).filter("error is null")
    return documents.with_text_references(rows.select("archive", "path", "content"))
