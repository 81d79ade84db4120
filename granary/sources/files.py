"""A sink that writes a file for each row: ``rows.write.format("files")`` of (path, content), text or bytes; and trees of files read.

Paths are relative to the folder; one that leaves it is an error. A file is written under another name and moved, so it is whole or
not there; a path that comes again replaces its file. Tasks write through ``pyarrow.fs``, wherever the folder is.

``read_files`` and ``new_files`` list a tree in tasks, so the driver knows the number of slices and no file: entries of the first
level that has as many folders as there are slices are dealt out by hash of their path, and each task walks its own. A flat folder
is listed once by each slice, so writers of many files had better put them in ``shard`` folders. Names that begin with a dot or an
underscore are not seen, as by Spark's own sources.

Millions of small files are more than a file system holds (an inode and a block each) and far slower to make than to fill.
``write_files(packed=True)`` puts them in zip archives, each of which stands for the folder it lies in, and ``read_versions`` reads
archives and single files of a tree alike (``read_places`` and ``read_at``: first where they lie, then what is asked for). Archives are only added, under names that grow with time: a path that comes again is a
newer version, and the largest ``written`` of a path is the file. A task's archives are hidden until the write is committed, so those
of failed attempts are never read.
"""

from __future__ import annotations

import io
import re
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import chain
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from granary.session import ship

#: Shard folders; bytes and rows of a batch of contents.
SHARDS, BATCH, ROWS = 256, 4 << 20, 1024
#: Bytes and members after which an archive is closed; contents up to this many bytes are not compressed. A task holds one archive.
FULL, MEMBERS, SHORT = 16 << 20, 16_384, 128
#: Time of the write in nanoseconds, number within it.
ARCHIVE = re.compile(r"\d{20}-\d{6}\.zip")


def safe(path: str) -> bool:
    p = PurePosixPath(path or "")
    return bool(p.name) and not p.is_absolute() and ".." not in p.parts and "\0" not in path


class FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, base = fs.FileSystem.from_uri(self.path)
        made = None
        for row in iterator:
            if not safe(row["path"]):
                raise ValueError(f"{row['path']!r} is no path within the folder")
            whole = PurePosixPath(base, row["path"])
            if whole.parent != made:
                system.create_dir(str(whole.parent), recursive=True)
                made = whole.parent
            part = str(whole.parent / f".{uuid.uuid4().hex}")
            content = row["content"]
            with system.open_output_stream(part) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            system.move(part, str(whole))
        return WriterCommitMessage()


@dataclass
class Packed(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Packed:
        system, base = fs.FileSystem.from_uri(self.path)
        system.create_dir(base, recursive=True)
        rows = ((path, content) for b in iterator for path, content in zip(b.column("path").to_pylist(), b.column("content").cast(pa.binary()).to_pylist(), strict=True))
        return Packed([_archive(system, base, chain([first], rows)) for first in rows])

    def commit(self, messages: list[Packed | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        last = max((int(x.base_name[:20]) for x in _entries(system, base) if ARCHIVE.fullmatch(x.base_name)), default=0)
        at = max(time.time_ns(), last + 1)
        for k, name in enumerate(name for m in messages if m for name in m.names):
            system.move(f"{base}/{name}", f"{base}/{at:020d}-{k:06d}.zip")

    def abort(self, messages: list[Packed | None]) -> None:
        system, base = fs.FileSystem.from_uri(self.path)
        for name in (name for m in messages if m for name in m.names):
            if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                system.delete_file(f"{base}/{name}")


def _archive(system: fs.FileSystem, base: str, rows: Iterator[tuple[str, bytes | None]]) -> str:
    """One hidden archive of the next rows, until it is full."""
    name, held = f".{uuid.uuid4().hex}", io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for n, (path, content) in enumerate(rows, 1):
            if not safe(path):
                raise ValueError(f"{path!r} is no path within the folder")
            z.writestr(str(PurePosixPath(path)), content or b"", zipfile.ZIP_DEFLATED if len(content or b"") > SHORT else zipfile.ZIP_STORED, 1)
            if n == MEMBERS or held.tell() >= FULL:
                break
    with system.open_output_stream(f"{base}/{name}") as f:
        f.write(held.getbuffer())
    return name


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FileWriter | ArchiveWriter:
        if overwrite:
            raise ValueError("the sink adds files")
        return (ArchiveWriter if self.options.get("packed") == "true" else FileWriter)(self.options["path"])


def write_files(rows: DataFrame, folder: str, packed: bool = False) -> None:
    """Write (path, content) rows below a folder, each as a file or as a member of an archive of many."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(FileSink)
    rows.select("path", "content").write.format("files").mode("append").option("path", _uri(folder)).option("packed", packed).save()


def shard(key: Column) -> Column:
    """A folder for a key, one of ``SHARDS``."""
    return F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(key), F.lit(SHARDS))), 2, "0"))


def _entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [x for x in found if x.base_name[:1] not in ("", ".", "_")]


def _level(system: fs.FileSystem, base: str, slices: int) -> tuple[list[fs.FileInfo], list[fs.FileInfo]]:
    """The files above the level that is dealt out, and its folders."""
    above, level = [], [base]
    while True:
        entries = [x for folder in level for x in _entries(system, folder)]
        above += [x for x in entries if x.type == fs.FileType.File]
        folders = [x for x in entries if x.type == fs.FileType.Directory]
        if not folders or len(folders) >= slices:
            return above, folders
        level = [x.path for x in folders]


def _mine(base: str, own: int, slices: int) -> Callable[[fs.FileInfo], bool]:
    return lambda x: zlib.crc32(x.path.removeprefix(base).encode()) % slices == own


def owned(system: fs.FileSystem, base: str, ending: str | tuple[str, ...], own: int, slices: int) -> Iterator[fs.FileInfo]:
    """The files of one slice of a tree; all slices together are the whole."""
    mine = _mine(base, own, slices)
    above, folders = _level(system, base, slices)
    yield from (x for x in above if x.base_name.endswith(ending) and mine(x))
    todo = [x.path for x in folders if mine(x)]
    while todo:
        for x in _entries(system, todo.pop()):
            if x.type == fs.FileType.Directory:
                todo.append(x.path)
            elif x.base_name.endswith(ending):
                yield x


def slices_of(spark: SparkSession) -> int:
    """Tasks among which a tree is dealt out."""
    return min(SHARDS, 4 * spark.sparkContext.defaultParallelism)


def _batches(rows: Iterator[tuple], *names: str) -> Iterator[pa.RecordBatch]:
    """Rows of texts, the last one a text or bytes, as batches of bounded size."""
    kinds = [pa.binary() if name == "content" else pa.string() for name in names]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], list(names))
    found, held = [], 0
    for row in rows:
        found.append(row)
        held += len(row[-1])
        if held >= BATCH or len(found) >= ROWS:
            yield batch()
            found, held = [], 0
    if found:
        yield batch()


def _read(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path) as f:
        return f.read()


def _tree(folder: str, ending: str, slices: int) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for b in it:
            for own in b.column(0).to_pylist():
                yield from _batches(((x.path.removeprefix(base).lstrip("/"), _read(system, x.path)) for x in owned(system, base, ending, own, slices)), "path", "content")

    return run


def read_files(spark: SparkSession, folder: str, ending: str = "") -> DataFrame:
    """(path, content) of the files of a tree whose names end so; paths are relative to the folder, contents are bytes."""
    ship(spark)
    n = slices_of(spark)
    return spark.range(0, n, 1, n).mapInArrow(_tree(_uri(folder), ending, n), "path string, content binary")


def _members(z: zipfile.ZipFile, at: str, endings: tuple[str, ...]) -> Iterator[tuple[str, str, int]]:
    """(path, written, number) of an archive's members; ``at`` is the archive's own path."""
    folder, _, name = at.rpartition("/")
    for n, x in enumerate(z.infolist()):
        if x.filename.endswith(endings) and not any(part[:1] in ("", ".", "_") for part in x.filename.split("/")):
            yield f"{folder}/{x.filename}".lstrip("/"), f"{name.removesuffix('.zip')}-{n:06d}", n


def _sliced(spark: SparkSession, folder: str, endings: tuple[str, ...], found: Callable, schema: str) -> DataFrame:
    """What ``found`` yields of the archives and files of a tree, which are dealt out over tasks."""
    ship(spark)
    uri, slices, endings = _uri(folder), slices_of(spark), endings or ("",)
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(system: fs.FileSystem, base: str, own: int) -> Iterator[tuple]:
        for x in owned(system, base, (*endings, ".zip"), own, slices):
            if (packed := bool(ARCHIVE.fullmatch(x.base_name))) or x.base_name.endswith(endings):
                yield from found(system, x, x.path.removeprefix(base).lstrip("/"), packed, endings)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        for b in it:
            for own in b.column(0).to_pylist():
                yield from _batches(rows(system, base, own), *names)

    return spark.range(0, slices, 1, slices).mapInArrow(run, schema)


def _whole(system: fs.FileSystem, x: fs.FileInfo, path: str, packed: bool, endings: tuple[str, ...]) -> Iterator[tuple[str, str, bytes]]:
    if not packed:
        yield path, f"{x.mtime_ns or 0:020d}-{path}", _read(system, x.path)
        return
    with zipfile.ZipFile(io.BytesIO(_read(system, x.path))) as z:
        members = z.infolist()
        yield from ((name, written, z.read(members[n])) for name, written, n in _members(z, path, endings))


def _places(system: fs.FileSystem, x: fs.FileInfo, path: str, packed: bool, endings: tuple[str, ...]) -> Iterator[tuple[str, str, str, str]]:
    if not packed:
        yield path, f"{x.mtime_ns or 0:020d}-{path}", path, ""
        return
    with system.open_input_file(x.path) as f, zipfile.ZipFile(f) as z:
        yield from ((name, written, path, str(n)) for name, written, n in _members(z, path, endings))


def read_versions(spark: SparkSession, folder: str, *endings: str) -> DataFrame:
    """(path, written, content) of the files of a tree, and of the members of its archives, whose names end in one of these. A path
    comes as often as it was written; the largest ``written`` of a path, a text that begins with the time, is what it holds."""
    return _sliced(spark, folder, endings, _whole, "path string, written string, content binary")


def read_places(spark: SparkSession, folder: str, *endings: str) -> DataFrame:
    """(path, written, at, n) of the same: not what it holds but where it lies, by the directories of the archives alone."""
    return _sliced(spark, folder, endings, _places, "path string, written string, at string, n string")


def read_at(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with ``at`` and ``n`` of ``read_places``, both replaced by the content; null where they are null. Rows go to the archive,
    which is opened once and of which only what is asked for is read, and no content is shuffled."""
    spark = rows.sparkSession
    ship(spark)
    uri, kept = _uri(folder), [c for c in rows.columns if c not in ("at", "n")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        opened, z, members = None, None, []
        for b in it:
            contents, held, begin = [], 0, 0
            own = b.select(kept)
            for i, (at, n) in enumerate(zip(b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True), 1):
                if n and at != opened:
                    opened, z = at, zipfile.ZipFile(io.BytesIO(_read(system, f"{base}/{at}")))
                    members = z.infolist()
                contents.append(None if at is None else z.read(members[int(n)]) if n else _read(system, f"{base}/{at}"))
                held += len(contents[-1] or b"")
                if held >= BATCH or len(contents) >= ROWS or i == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*own.slice(begin, len(contents)).columns, pa.array(contents, pa.binary())], [*kept, "content"])
                    contents, held, begin = [], 0, i

    # A row without a place goes anywhere, and not to one task with all its like.
    dealt = rows.repartition(slices_of(spark), F.coalesce("at", F.xxhash64(*kept).cast("string"))).sortWithinPartitions("at", F.col("n").cast("int"))
    return dealt.mapInArrow(run, rows.select(*kept, F.lit(None).cast("binary").alias("content")).schema)


def clear(spark: SparkSession, folder: str) -> None:
    """Tasks delete the ``shard`` folders of a tree; what lies above them stays."""
    uri, slices = _uri(folder), slices_of(spark)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(uri)
        for b in it:
            for k in (k for own in b.column(0).to_pylist() for k in range(own, SHARDS, slices)):
                if system.get_file_info(f"{base}/{k:02x}").type == fs.FileType.Directory:
                    system.delete_dir(f"{base}/{k:02x}")
            yield b

    ship(spark)
    spark.range(0, slices, 1, slices).mapInArrow(run, "id long").count()


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"


@dataclass
class Slice(InputPartition):
    own: int
    until: int


class FolderStream(DataSourceStreamReader):
    """Every trigger lists the files that were there by its time; those of earlier ones are told apart by state, not here."""

    def __init__(self, options: dict):
        self.path, self.ending, self.slices = options["path"], options["ending"], int(options["slices"])

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return [Slice(k, end["until"]) for k in range(self.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        system, base = fs.FileSystem.from_uri(self.path)
        for x in owned(system, base, self.ending, partition.own, self.slices):
            if (at := (x.mtime_ns or 0) // 1000) <= partition.until:
                yield x.path.removeprefix(base).lstrip("/"), datetime.fromtimestamp(at / 1e6, UTC), x.size


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long"

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)


def _opened(folder: str) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for b in it:
            yield from _batches(((path, _read(system, f"{base}/{path}")) for path in b.column(0).to_pylist()), "path", "content")

    return run


def new_files(spark: SparkSession, folder: str, ending: str = "") -> DataFrame:
    """A stream of (path, content) of the files that come into a tree, each path once; which ones were seen is state of the stream,
    kept by executors. A micro-batch that is run again lists what was there by its time."""
    ship(spark)
    spark.dataSource.register(FolderSource)
    there = spark.readStream.format("folder").option("path", _uri(folder)).option("ending", ending).option("slices", slices_of(spark)).load()
    return there.select("path").dropDuplicates(["path"]).mapInArrow(_opened(_uri(folder)), "path string, content binary")
