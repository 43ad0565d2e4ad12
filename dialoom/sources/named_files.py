"""A data source that writes one named file for each group of rows, all or none.

Each task writes its files into a staging folder beside the target; only when all tasks are done does the
driver move them to their names, so a failed or repeated task leaves no half-written and no double file.
The names lie in sorted lists in the staging folder, which the driver merges line by line: it holds a line of each list, not the names.
"""

from __future__ import annotations

import heapq
import io
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from dialoom.sources.arrow_files import entries, located

NAME = "_file"
#: Names that a task holds to sort them, and lists that the driver has open at once.
HELD, OPEN_LISTS = 32_768, 256


@dataclass
class Written(WriterCommitMessage):
    """Names in the staging folder of the lists of a task's files."""

    lists: list[str]


def _reads(system: fs.FileSystem, path: str) -> Iterator[str]:
    """The lines of a list: a file's name as in JSON, its rows and its place in the staging folder, with tabs between."""
    with io.TextIOWrapper(system.open_input_stream(path), encoding="ascii", newline="\n") as lines:
        yield from lines


def _writes(system: fs.FileSystem, path: str) -> io.TextIOWrapper:
    return io.TextIOWrapper(system.open_output_stream(path), encoding="ascii", newline="\n")


class _Lists:
    """Lists of a task's files, each in order: one if the names come in order."""

    def __init__(self, system: fs.FileSystem, staging: str, task: str):
        self.system, self.staging, self.task = system, staging, task
        self.names, self.held, self.out, self.last = [], [], None, ""

    def add(self, name: str, rows: int, staged: str) -> None:
        if name is None:
            raise ValueError(f"{rows} rows name no file")
        self.held.append(f"{json.dumps(name)[1:-1]}\t{rows}\t{staged}\n")
        if len(self.held) == HELD:
            self._put()

    def _put(self) -> None:
        self.held.sort()
        if self.out is None or self.held[0] < self.last:
            self._end()
            self.names.append(f"{self.task}/list-{len(self.names)}")
            self.out = _writes(self.system, f"{self.staging}/{self.names[-1]}")
        self.out.writelines(self.held)
        self.last, self.held = self.held[-1], []

    def _end(self) -> None:
        if self.out is not None:
            self.out.close()

    def close(self) -> list[str]:
        if self.held:
            self._put()
        self._end()
        return self.names


class _Text:
    """A JSON document, a list or the list under a name of an object, or JSON lines, written row by row."""

    def __init__(self, out: pa.NativeFile, schema: pa.Schema, options: dict):
        self.out, self.lines, self.raw, self.first = out, options["kind"] == "jsonl", options.get("value"), True
        head, under = json.loads(options.get("head", "{}")), options.get("under")
        start = "[" if under is None else json.dumps(head)[:-1] + (", " if head else "") + json.dumps(under) + ": ["
        self.end = "]" if under is None else "]}"
        self._put("" if self.lines else start)

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def add(self, batch: pa.RecordBatch) -> None:
        for row in batch.to_pylist():
            text = row[self.raw] if self.raw else json.dumps(row, default=str, ensure_ascii=False)
            self._put(text + "\n" if self.lines else ("" if self.first else ",\n ") + text)
            self.first = False

    def close(self) -> None:
        self._put("" if self.lines else self.end + "\n")


class _Arrow:
    """An Arrow stream."""

    def __init__(self, out: pa.NativeFile, schema: pa.Schema, options: dict):
        self.writer = pa.ipc.new_stream(out, schema)

    def add(self, batch: pa.RecordBatch) -> None:
        self.writer.write_batch(batch)

    def close(self) -> None:
        self.writer.close()


_KINDS = {"json": _Text, "jsonl": _Text, "arrow": _Arrow}


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.target = options["path"].rstrip("/")
        self.staging = f"{self.target}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, staging = located(self.staging)
        task = uuid.uuid4().hex
        system.create_dir(f"{staging}/{task}", recursive=True)
        done, name, out, writer, rows, files = _Lists(system, staging, task), None, None, None, 0, 0

        def finish() -> None:
            if writer is not None:
                writer.close()
                out.close()
                done.add(name, rows, staged)

        for batch in iterator:
            names = batch.column(NAME).to_pylist()
            body = batch.drop_columns([NAME])
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at] != name:
                    finish()
                    name, rows, staged, files = names[at], 0, f"{task}/{files}", files + 1
                    out = system.open_output_stream(f"{staging}/{staged}")
                    writer = _KINDS[self.options["kind"]](out, body.schema, self.options)
                writer.add(body.slice(at, to - at))
                rows += to - at
                at = to
        finish()
        return Written(done.close())

    def commit(self, messages: list[Written | None]) -> None:
        system, target = located(self.target)
        staging = located(self.staging)[1]
        system.create_dir(staging, recursive=True)
        twice = self._merge(system, staging, [name for m in messages if m is not None for name in m.lists])
        if twice:
            self.abort(messages)
            raise ValueError(f"several tasks wrote the files {twice}: rows of one file must be in one partition")
        if self.overwrite:
            for old in self._old(system, target):
                system.delete_file(old)
        last = ""
        for line in _reads(system, f"{staging}/files"):
            text, _, staged = line.rstrip("\n").split("\t")
            name = json.loads(f'"{text}"')
            folder = name.rpartition("/")[0]
            if folder != last:
                system.create_dir(f"{target}/{folder}", recursive=True)
                last = folder
            system.move(f"{staging}/{staged}", f"{target}/{name}")
        system.move(f"{staging}/manifest", f"{target}/_manifest.json")
        self._clear(system)

    def _merge(self, system: fs.FileSystem, staging: str, lists: list[str]) -> list[str]:
        """Writes all files as one list, ``files``, and as the manifest; returns the first names that are there twice, of which neither must be used."""
        for n in range(len(lists)):
            if len(lists) <= OPEN_LISTS:
                break
            with _writes(system, f"{staging}/merged-{n}") as out:
                out.writelines(self._merged(system, staging, lists[:OPEN_LISTS]))
            lists = [*lists[OPEN_LISTS:], f"merged-{n}"]
        twice, last = [], None
        with _writes(system, f"{staging}/files") as files, _writes(system, f"{staging}/manifest") as manifest:
            manifest.write("{")
            for line in self._merged(system, staging, lists):
                text, rows, _ = line.split("\t")
                if text == last and len(twice) < 5 and text not in twice:
                    twice.append(text)
                manifest.write(f'{"" if last is None else ", "}"{text}": {rows}')
                files.write(line)
                last = text
            manifest.write("}")
        return [json.loads(f'"{text}"') for text in twice]

    def _merged(self, system: fs.FileSystem, staging: str, lists: list[str]) -> Iterable[str]:
        return heapq.merge(*(_reads(system, f"{staging}/{name}") for name in lists))

    def _old(self, system: fs.FileSystem, folder: str) -> Iterator[str]:
        """Files of an earlier write, without those that are staged."""
        for name, is_file in [(name, is_file) for name, is_file, _ in entries(system, folder) if not name.startswith("_staging-")]:
            if is_file:
                yield f"{folder}/{name}"
            else:
                yield from self._old(system, f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(located(self.target)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        staging = located(self.staging)[1]
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class NamedFiles(DataSource):
    """Options: path, kind (json, jsonl, arrow), and for json value (a column of JSON texts), head (a JSON object) and under (the list's name in it)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(dict(self.options), overwrite)
