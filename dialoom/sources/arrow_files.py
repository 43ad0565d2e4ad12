"""Arrow files as tables of frames: one row for each frame, read by ranges of rows.

A data source ``arrow_frames`` over Arrow IPC streams and files. Planning goes through one folder at a time, and gives small files, many together, as partitions:
folders of few small files by the folder's name, so that planning keeps no list of the files, others by their own. Tasks open them.
Of large files it reads the messages' heads only: it notes where each record batch lies and which rows it holds, and gives runs of batches as partitions.
A range of frames, by option or by a filter on ``frame_idx`` that Spark pushes down, leaves out all batches that it does not meet.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema

#: Rows that a partition aims at; a row counts ROW_BYTES where only a file's size is known, and at most FILES small files are one partition.
PARTITION_ROWS = 65_536
ROW_BYTES, FILES = 64, 512
#: Rows that small files' batches are joined to before Spark gets them.
JOINED_ROWS = 8192
_FILE_MAGIC = b"ARROW1"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI; Hadoop writes local ones as file:/x."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(Name, whether it is a file, bytes of an Arrow file) of what lies in a folder, in any order."""
    if not isinstance(system, fs.LocalFileSystem):
        yield from ((f.base_name, f.is_file, f.size or 0) for f in system.get_file_info(fs.FileSelector(folder)))
        return
    with os.scandir(folder) as found:
        for e in found:
            is_file = e.is_file()
            if is_file or e.is_dir():
                yield e.name, is_file, e.stat().st_size if is_file and e.name.endswith(".arrow") else 0


def _under(system: fs.FileSystem, folder: str) -> tuple[list[tuple[str, int]], list[str]]:
    """A folder's own Arrow files as (path, bytes), and the names of its folders, both in order."""
    files, folders = [], []
    for name, is_file, size in entries(system, folder):
        if not is_file:
            folders.append(name)
        elif name.endswith(".arrow"):
            files.append((f"{folder}/{name}", size))
    return sorted(files), sorted(folders)


def arrow_folders(path: str) -> Iterator[tuple[str | None, list[tuple[str, int]]]]:
    """(Folder, its own Arrow files as (path, bytes)) of ``path`` and of all folders under it, one at a time; no folder if ``path`` is a file."""
    system, where = located(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.File:
        yield None, [(path, info.size)]
        return
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)

    def listed(folder: str) -> Iterator[tuple[str, list[tuple[str, int]]]]:
        files, folders = _under(system, folder)
        yield folder, files
        for name in folders:
            yield from listed(f"{folder}/{name}")

    yield from listed(where.rstrip("/"))


def arrow_files(path: str) -> list[tuple[str, int]]:
    """(Path, bytes) of ``path`` itself, or of all Arrow files under it, in order of their names."""
    return sorted(f for _, files in arrow_folders(path) for f in files)


def first_arrow_file(path: str) -> str:
    """The first of ``arrow_files``, without listing the folders behind it."""
    system, where = located(path)
    if system.get_file_info(where).type == fs.FileType.File:
        return path

    def first(folder: str) -> str | None:
        for name in sorted(name if is_file else name + "/" for name, is_file, _ in entries(system, folder)):
            if name.endswith("/"):
                under = first(f"{folder}/{name.rstrip('/')}")
                if under is not None:
                    return under
            elif name.endswith(".arrow"):
                return f"{folder}/{name}"
        return None

    one = first(where.rstrip("/"))
    if one is None:
        raise FileNotFoundError(f"no Arrow files under {path}")
    return one


def _opened(path: str) -> pa.NativeFile:
    system, where = located(path)
    return pa.memory_map(where) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(where)


@dataclass
class Batch:
    """Where a record batch lies in its file, and its rows [first, first + rows)."""

    at: int
    first: int
    rows: int


def batches_of(path: str) -> tuple[pa.Schema, list[Batch], list[int]]:
    """(Schema, record batches, places of dictionaries) of an Arrow file or stream; in a file, ``at`` is the batch's number."""
    with _opened(path) as source:
        if source.read(len(_FILE_MAGIC)) == _FILE_MAGIC:
            reader, out, first = pa.ipc.open_file(source), [], 0
            for i in range(reader.num_record_batches):
                rows = reader.get_batch(i).num_rows
                out.append(Batch(i, first, rows))
                first += rows
            return reader.schema, out, []
        source.seek(0)
        schema, out, dictionaries, first = pa.ipc.read_schema(source), [], [], 0
        while True:
            at = source.tell()
            try:
                message = pa.ipc.read_message(source)
            except EOFError:
                return schema, out, dictionaries
            if message.type == "dictionary":
                dictionaries.append(at)
                continue
            rows = pa.ipc.read_record_batch(message, schema).num_rows if not dictionaries else _rows_with(source, path, dictionaries, at)
            out.append(Batch(at, first, rows))
            first += rows


def _rows_with(source: pa.NativeFile, path: str, dictionaries: list[int], at: int) -> int:
    back = source.tell()
    rows = sum(b.num_rows for b in _read(path, dictionaries, [at]))
    source.seek(back)
    return rows


def _read(path: str, dictionaries: list[int], places: list[int]) -> Iterator[pa.RecordBatch]:
    """The record batches at these places of a file or stream."""
    with _opened(path) as source:
        if source.read(len(_FILE_MAGIC)) == _FILE_MAGIC:
            reader = pa.ipc.open_file(source)
            yield from (reader.get_batch(i) for i in places)
            return
        source.seek(0)
        head = pa.ipc.read_message(source).serialize()
        for place in places:
            parts = [head]
            for at in [d for d in dictionaries if d < place] + [place]:
                source.seek(at)
                parts.append(pa.ipc.read_message(source).serialize())
            yield from pa.ipc.open_stream(pa.py_buffer(b"".join(bytes(p) for p in parts)))


@dataclass
class Run(InputPartition):
    """A run of record batches of one file, and the rows of them that are asked for."""

    path: str
    dictionaries: list[int]
    batches: list[Batch]
    start: int
    end: int


@dataclass
class Files(InputPartition):
    """Small files as a whole, by their names in a folder, and the rows of each that are asked for; ``strict`` if all of these must be there."""

    folder: str
    names: list[str]
    start: int
    end: int | None
    strict: bool


def _checked(path: str, start: int, end: int | None, strict: bool, total: int) -> None:
    if strict and end > total or start < 0:
        raise ValueError(f"frames [{start}, {end}) are out of range: {path} has {total}")


def _small(part: Files, path: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(Rows asked for, number of the first) of a small file's batches."""
    _checked(path, part.start, None, False, 0)
    total = 0
    with _opened(path) as source:
        is_file = source.read(len(_FILE_MAGIC)) == _FILE_MAGIC
        source.seek(0)
        if is_file:
            reader = pa.ipc.open_file(source)
            batches = (reader.get_batch(i) for i in range(reader.num_record_batches))
        else:
            batches = pa.ipc.open_stream(source)
        for batch in batches:
            lo = max(part.start - total, 0)
            hi = batch.num_rows if part.end is None else min(part.end - total, batch.num_rows)
            if lo < hi:
                yield batch.slice(lo, hi - lo), total + lo
            total += batch.num_rows
            if part.end is not None and total >= part.end:
                return
    _checked(path, part.start, part.end, part.strict, total)


def _named(path: str, batch: pa.RecordBatch, first: int) -> pa.RecordBatch:
    name = path.rsplit("/", 1)[-1].removesuffix(".arrow")
    index = pa.array(range(first, first + batch.num_rows), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), index, *batch.columns], names=["video_uid", "frame_idx", *batch.schema.names])


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``; a batch of another schema is not joined with those before."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if held and (n >= rows or batch.schema != held[0].schema):
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.concat_batches(held)


@dataclass
class Files(InputPartition):
    """Small files as a whole, by the common start of their paths and the rest, and the rows of each that are asked for; ``strict`` if these must be there.

    A path with a slash at its end is a folder and stands for its own Arrow files; ``files`` is the number of all.
    """

    prefix: str
    rest: list[str]
    files: int
    start: int
    end: int | None
    strict: bool


def _checked(path: str, start: int, end: int | None, strict: bool, total: int) -> None:
    if strict and end > total or start < 0:
        raise ValueError(f"frames [{start}, {end}) are out of range: {path} has {total}")


def _paths(part: Files) -> Iterator[str]:
    """A partition's files, listed again where it names their folder; an error if there are not as many as when it was planned."""
    n = 0
    for path in (part.prefix + rest for rest in part.rest):
        if path.endswith("/"):
            system, folder = located(path)
            found = [f for f, _ in _under(system, folder.rstrip("/"))[0]]
        else:
            found = [path]
        n += len(found)
        yield from found
    if n != part.files:
        raise ValueError(f"{part.files} files were planned and {n} found under {part.prefix}: they changed before they were read")


def _slices(path: str, part: Files) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(Number of the first, rows asked for) of a small file's batches."""
    total = 0
    with _opened(path) as source:
        is_file = source.read(len(_FILE_MAGIC)) == _FILE_MAGIC
        source.seek(0)
        reader = pa.ipc.open_file(source) if is_file else pa.ipc.open_stream(source)
        for batch in (reader.get_batch(i) for i in range(reader.num_record_batches)) if is_file else reader:
            lo, hi = max(part.start - total, 0), batch.num_rows if part.end is None else min(part.end - total, batch.num_rows)
            if lo < hi:
                yield total + lo, batch.slice(lo, hi - lo)
            total += batch.num_rows
            if part.end is not None and total >= part.end:
                break
    _checked(path, part.start, part.end, part.strict, total)


def _named(path: str, first: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    name = path.rsplit("/", 1)[-1].removesuffix(".arrow")
    index = pa.array(range(first, first + batch.num_rows), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.string()), index, *batch.columns], names=["video_uid", "frame_idx", *batch.schema.names])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about JOINED_ROWS or more; one with another schema or with dictionaries stays apart."""
    held, rows = [], 0
    for batch in batches:
        if held and (rows >= JOINED_ROWS or batch.schema != held[0].schema or any(pa.types.is_dictionary(f.type) for f in batch.schema)):
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


class ArrowFramesReader(DataSourceReader):
    def __init__(self, path: str, start: int, end: int | None, rows: int):
        self.path, self.start, self.end, self.rows = path, start, end, rows
        self.strict = end is not None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not (hasattr(f, "attribute") and f.attribute == ("frame_idx",) and hasattr(f, "value")):
                yield f
            elif isinstance(f, GreaterThanOrEqual | GreaterThan):
                self.start = max(self.start, int(f.value) + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self._until(int(f.value) + isinstance(f, LessThanOrEqual))
            elif isinstance(f, EqualTo):
                self.start = max(self.start, int(f.value))
                self._until(int(f.value) + 1)
            else:
                yield f

    def _until(self, end: int) -> None:
        self.end, self.strict = end if self.end is None else min(self.end, end), False

    def partitions(self) -> list[Run | Files]:
        out, small, files, size, most = [], [], 0, 0, self.rows * ROW_BYTES

        def together() -> None:
            prefix = os.path.commonprefix(small)
            out.append(Files(prefix, [path[len(prefix) :] for path in small], files, self.start, self.end, self.strict))

        for folder, found in arrow_folders(self.path):
            whole = sum(n for _, n in found)
            if folder is not None and found and len(found) <= FILES and whole <= most:
                units = [(f"{folder}/", len(found), whole)]
            else:
                units = [(path, 1, n) for path, n in found]
            for path, count, n in units:
                if n > most:
                    out += self._runs(path)
                    continue
                if small and (size + n > most or files + count > FILES):
                    together()
                    small, files, size = [], 0, 0
                small.append(path)
                files += count
                size += n
        if small:
            together()
        return out

    def _runs(self, path: str) -> Iterator[Run]:
        _, batches, dictionaries = batches_of(path)
        total = batches[-1].first + batches[-1].rows if batches else 0
        _checked(path, self.start, self.end, self.strict, total)
        end = total if self.end is None else self.end
        run: list[Batch] = []
        for batch in batches:
            if batch.rows and batch.first < end and batch.first + batch.rows > self.start:
                if run and sum(b.rows for b in run) + batch.rows > self.rows:
                    yield Run(path, dictionaries, run, self.start, end)
                    run = []
                run.append(batch)
        if run:
            yield Run(path, dictionaries, run, self.start, end)

    def read(self, partition: Run | Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        if isinstance(partition, Files):
            yield from _joined(_named(path, first, batch) for path in _paths(partition) for first, batch in _slices(path, partition))
            return
        for place, batch in zip(partition.batches, _read(partition.path, partition.dictionaries, [b.at for b in partition.batches]), strict=True):
            lo, hi = max(partition.start - place.first, 0), min(partition.end - place.first, place.rows)
            yield _named(partition.path, place.first + lo, batch.slice(lo, hi - lo))


class ArrowFrames(DataSource):
    """Options: path; start and end (a range that must be there), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_frames"

    def schema(self) -> T.StructType:
        with _opened(first_arrow_file(self.options["path"])) as source:
            is_file = source.read(len(_FILE_MAGIC)) == _FILE_MAGIC
            source.seek(0)
            own = pa.ipc.open_file(source).schema if is_file else pa.ipc.read_schema(source)
        found = from_arrow_schema(own)
        return T.StructType([T.StructField("video_uid", T.StringType()), T.StructField("frame_idx", T.LongType()), *found.fields])

    def reader(self, schema: T.StructType) -> ArrowFramesReader:
        end = self.options.get("end")
        return ArrowFramesReader(self.options["path"], int(self.options.get("start", 0)), None if end is None else int(end), int(self.options.get("rows", PARTITION_ROWS)))


def arrow_frames(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, rows: int = PARTITION_ROWS) -> DataFrame:
    """(video_uid, frame_idx, ...) of an Arrow file or of all under a folder; with ``start`` and ``end`` these frames of each file, an error where a file has fewer.

    Filters on frame_idx reach the files. Paths are those of a shared file system that all workers see, or URIs that Arrow opens.
    """
    spark.dataSource.register(ArrowFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("arrow_frames").option("path", path).option("rows", rows)
    if start is not None:
        reader = reader.option("start", start)
    return (reader if end is None else reader.option("end", end)).load()
